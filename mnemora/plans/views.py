"""The order tables seen as an institution's record: orders are decisions on customers, lines are actions for suppliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import PROVENANCE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _said(key, what: str):
    """One sentence as provenance."""
    return F.array(F.struct(F.lit("orders").alias("document_id"), F.lit("orders.parquet").alias("filename"), F.lit(None).cast("int").alias("page"), key.alias("chunk_id"), F.concat(F.lit(f"{what} "), key).alias("evidence"), F.lit("table").alias("mode"))).cast(f"array<{PROVENANCE}>")


def record(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts). Finished orders were approved on their date, open ones proposed on it, partial ones deferred without a date
    of their own but in a sentence that dates the decision; the priority is the reason."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("a"), F.col("l_suppkey").cast("string").alias("s"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"))
    none = F.array().cast(f"array<{PROVENANCE}>")

    def node(df: DataFrame, id_, name, kind: str, date=None) -> DataFrame:
        return df.select(id_.alias("id"), name.alias("name"), F.lit(kind).alias("type"), F.array().cast("array<string>").alias("aliases"), (F.lit(None).cast("string") if date is None else date).alias("date_iso"), F.lit(None).cast("string").alias("description"), F.lit(False).alias("source_document"), none.alias("provenance"))

    def fact(df: DataFrame, source, relation, target, date, said) -> DataFrame:
        return df.select(source.alias("source_id"), target.alias("target_id"), relation.alias("relation"), date.alias("date_iso"), said.alias("provenance"))

    p = lambda prefix, col: F.concat(F.lit(f"{prefix}:"), F.col(col))
    no = F.lit(None).cast("string")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c"), "c_name")
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s"), "s_name")
    days = o.select("d").union(lines.select("d")).distinct()
    nodes = [
        node(o, p("DECISION", "k"), F.concat(F.lit("order "), "k"), "DECISION"), node(cust, p("PERSON", "c"), F.col("c_name"), "PERSON"), node(supp, p("DEPARTMENT", "s"), F.col("s_name"), "DEPARTMENT"),
        node(lines, p("ACTION", "a"), F.concat(F.lit("ship "), "a"), "ACTION"), node(days, p("DATE", "d"), F.col("d"), "DATE", F.col("d")), node(o.select("o_orderpriority").distinct(), p("REASON", "o_orderpriority"), F.col("o_orderpriority"), "REASON"),
    ]
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED_BY").when(F.col("o_orderstatus") == "O", "PROPOSED_BY").otherwise("DEFERRED_BY")
    own = _said(F.col("k"), "order")
    facts = [
        fact(o, p("DECISION", "k"), status, p("PERSON", "c"), F.when(F.col("o_orderstatus").isin("F", "O"), F.col("d")), own), fact(o.where("o_orderstatus <> 'O'"), p("DECISION", "k"), F.lit("DECIDED_ON"), p("DATE", "d"), F.col("d"), own),
        fact(o, p("DECISION", "k"), F.lit("JUSTIFIED_BY"), p("REASON", "o_orderpriority"), no, own), fact(lines, p("DECISION", "k"), F.lit("LED_TO"), p("ACTION", "a"), no, own),
        fact(lines, p("ACTION", "a"), F.lit("ASSIGNED_TO"), p("DEPARTMENT", "s"), no, own), fact(lines, p("ACTION", "a"), F.lit("DUE_ON"), p("DATE", "d"), no, own),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, facts)
