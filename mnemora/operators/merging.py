"""Merging entities of one type with nearly the same name.

Two names are close when their matching ratio is at least 0.92 and both have eight letters or more. In id order, an entity joins
the first earlier one that is close, has compatible dates and hasn't joined another itself.

A ratio of 0.92 leaves at most 0.08 of both lengths unmatched. So a name cut in one piece more than that has a piece that the other
holds unchanged, shifted by no more than that: candidates are an equi-join of pieces with the short substrings of other names.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import scratch
from ..functions import dates, text

RATIO, SHORTEST = 0.92, 8
#: Lengths of a name's pieces, which follow from the ratio for names of eight letters or more.
PIECES = (4, 5, 6)


def explicit_dates(name: Column, aliases: Column, date_iso: Column) -> Column:
    """All dates that an entity states in its names, and its own."""
    said = F.flatten(F.transform(F.concat(F.array(name), aliases), dates.dates_in_text))
    return F.array_distinct(F.array_compact(F.concat(said, F.array(date_iso))))


def keeps_apart(a: Column, b: Column, kind: Column) -> Column:
    """Whether the dates of two entities forbid a merge: they conflict, or, for meetings and events, only one side has any."""
    one_sided = (F.size(a) > 0) != (F.size(b) > 0)
    return dates.dates_conflict(a, b) | (one_sided & kind.isin("MEETING", "EVENT"))


def _close(pairs: DataFrame) -> DataFrame:
    """Those of pairs(a, b, ka, kb) whose names are close, in the order of their ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[SequenceMatcher(None, x, y).ratio() >= RATIO for x, y in zip(f["ka"], f["kb"], strict=True)], ["a", "b"]]

    return pairs.mapInPandas(run, "a string, b string")


def _grams(size: int) -> Column:
    """All substrings of a key with this length and where they start."""
    return F.transform(F.sequence(F.lit(0), F.col("n") - size), lambda i: F.struct(i.alias("at"), F.substring("key", i + 1, F.lit(size)).alias("piece")))


def close_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: entities of one type with close names and compatible dates; dates and documents have none."""
    own = nodes.where(~F.col("type").isin("DATE", "DOCUMENT")).select("id", "type", text.normalize_name(F.col("name"), F.col("type")).alias("key"), explicit_dates(F.col("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.col("date_iso")).alias("said"))
    own = own.withColumn("n", F.char_length("key")).where(F.col("n") >= SHORTEST)
    most = F.col("n") + F.floor(F.col("n") * (2 / RATIO - 1))
    own = own.withColumn("off", F.floor((1 - RATIO) * most + 1e-9).cast("int"))
    cut = lambda j: F.floor(j * F.col("n") / (F.col("off") + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("off")), lambda j: F.struct(cut(j).alias("at"), F.substring("key", cut(j) + 1, cut(j + 1) - cut(j)).alias("piece")))
    short = own.select("id", "type", "n", "off", F.explode(parts).alias("p")).select("id", "type", "n", "off", "p.at", "p.piece")
    grams = F.flatten(F.array(*[_grams(k) for k in PIECES]))
    long = own.select(F.col("id").alias("id2"), "type", F.col("n").alias("n2"), F.explode(grams).alias("p")).select("id2", "type", "n2", F.col("p.at").alias("at2"), "p.piece")
    fits = (F.col("id") != F.col("id2")) & F.col("n2").between(F.col("n"), F.col("n") * (2 / RATIO - 1) + 1e-9) & (F.abs(F.col("at") - F.col("at2")) <= F.col("off"))
    found = short.join(long, ["type", "piece"]).where(fits).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    side = lambda x: own.select(F.col("id").alias(x), F.col("key").alias(f"k{x}"), F.col("said").alias(f"d{x}"), F.col("type").alias(f"t{x}"))
    both = found.join(side("a"), "a").join(side("b"), "b").where(~keeps_apart(F.col("da"), F.col("db"), F.col("ta")))
    return _close(both.select("a", "b", "ka", "kb"))


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's checkpoint folder; a local one is set only where none is."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "merging"))
    return df.checkpoint()


def remap(nodes: DataFrame) -> DataFrame:
    """(id, into): the entities that join another. Each round settles those whose earlier close entities are all settled; one row
    a round comes to the driver."""
    pairs = _cut(close_pairs(nodes))
    left, joined = pairs, pairs.select(F.col("b").alias("id")).limit(0)
    while not left.isEmpty():
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        now = left.join(first, "a", "left_semi").select(F.col("b").alias("id")).distinct()
        joined = _cut(joined.unionByName(now))
        left = _cut(left.join(joined.withColumnRenamed("id", "a"), "a", "left_anti").join(joined.withColumnRenamed("id", "b"), "b", "left_anti").join(first, "a", "left_anti"))
    kept = pairs.join(joined.withColumnRenamed("id", "a"), "a", "left_anti").join(joined.withColumnRenamed("id", "b"), "b", "left_semi")
    return kept.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("into"))


def merge_close(nodes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with entities of close names as one: the kept name stays, others become aliases, the first date and description in
    id order stay, provenance is united. Facts move along; those between merged ends go, equal ones become one."""
    moved = remap(nodes)
    rank = F.struct(F.col("id") != F.col("into"), F.col("id"))
    rows = nodes.join(moved, "id", "left").withColumn("into", F.coalesce("into", "id"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)
    named = F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    out = rows.groupBy(F.col("into").alias("id")).agg(F.min_by("name", rank).alias("name"), F.min_by("type", rank).alias("type"), F.array_sort(F.array_distinct(named)).alias("aliases"), first("date_iso"), first("description"), F.bool_or("source_document").alias("source_document"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance")))).alias("provenance"))
    out = out.withColumn("aliases", F.array_except("aliases", F.array("name"))).select(nodes.columns)
    for end in ("source_id", "target_id"):
        facts = facts.join(moved.select(F.col("id").alias(end), F.col("into").alias("_into")), end, "left").withColumn(end, F.coalesce("_into", end)).drop("_into")
    facts = facts.where("source_id <> target_id").groupBy("source_id", "target_id", "relation", "date_iso").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance")))).alias("provenance"))
    return out, facts
