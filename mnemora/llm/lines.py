"""Line dedup by a log-template tree, in SQL functions only.

A line's path in the tree is its number of tokens and its first ``depth`` tokens; tokens with a digit are variable fields, and
so is all that follows the leading tokens. Lines on one path have one template. A template that occurs in ``min_docs``
documents or more is recurring: its lines go from all documents but the first (the least id). What follows the
leading tokens isn't compared: a line that differs there from all kept ones goes too, and that text is then in no document.

A template needs that many documents because it says little of a line. A long line says enough by itself: ``drop_repeated`` drops
lines of ``min_words`` tokens or ``min_chars`` characters that are exactly equal in two documents or more, from all but the first.

Defined cases: blank lines are kept and count as no template; null text is one empty line and stays null; rows with equal ids
are one document, so a template's documents are counted by distinct ids, and all rows with the least id keep their lines; null ids
count as no document and never are the first; an empty table has no rows; further columns stay as they are. A document's
lines are looked at a fixed number of times, however many it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, staged

DEPTH, MIN_DOCS = 6, 10
LONG_WORDS, LONG_CHARS = 50, 300
_BLANK = r"[\x09\x0B-\x0D\x20]+"


def template(line: Column, depth: int = DEPTH) -> Column:
    """The line's path as text: count, then the leading tokens with their variable fields masked; empty for a blank line."""
    tokens = F.filter(F.split(line, _BLANK), lambda t: t != "")
    lead = F.transform(F.slice(tokens, 1, depth), lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    return F.when(F.size(tokens) > 0, F.concat_ws(" ", F.size(tokens).cast("string"), lead)).otherwise("")


def long_line(line: Column, min_words: int = LONG_WORDS, min_chars: int = LONG_CHARS) -> Column:
    """The line itself if it has so many tokens or characters, else empty."""
    long = (F.char_length(line) >= min_chars) | (F.size(F.filter(F.split(line, _BLANK), lambda t: t != "")) >= min_words)
    return F.when(long & line.rlike(r"[^\x09\x0B-\x0D\x20]"), line).otherwise("")


def _key(path: Column) -> Column:
    return F.struct(F.xxhash64(path).alias("a"), F.xxhash64(F.lit("second seed"), path).alias("b"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``docs``, the text without recurring lines, and n_lines, n_dropped."""
    return _dropped(docs, id_col, text_col, lambda x: template(x, depth), min_docs)


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = LONG_WORDS, min_chars: int = LONG_CHARS) -> DataFrame:
    """The same without the long lines that a document with a lesser id holds exactly."""
    return _dropped(docs, id_col, text_col, lambda x: long_line(x, min_words, min_chars), 2)


def _dropped(docs: DataFrame, id_col: str, text_col: str, path: Callable[[Column], Column], min_docs: int) -> DataFrame:
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.toDF(*names.values())
    i, t = F.col(names[id_col]), F.col(names[text_col])
    lines = F.split(F.coalesce(t, F.lit("")), "\n")
    paths = F.transform(lines, lambda x, at: F.struct(at.alias("at"), path(x).alias("path")))
    keyed = F.transform(F.filter(paths, lambda p: p["path"] != ""), lambda p: F.struct(p["at"].alias("at"), _key(p["path"]).alias("key")))
    # The text's mark is worked out in a projection of its own: beside explode, it would be once for each line.
    each = docs.select(i.alias("id"), F.xxhash64(t).alias("mark"), keyed.alias("lines")).select("id", "mark", F.explode("lines").alias("line")).select("id", "mark", "line.at", "line.key")
    each = staged(each, "paths")  # parsing costs more than reading this twice
    recurring = each.groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_docs).select("key", "first")
    gone = each.join(apart(recurring, "key"), "key").where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "mark").agg(F.collect_set("at").alias("gone"))
    joined = docs.withColumn("mark", F.xxhash64(t)).join(gone.withColumnRenamed("mark", "gone_mark"), i.eqNullSafe(F.col("id")) & (F.col("mark") == F.col("gone_mark")), "left")
    # What stays is found by a set difference of places, in one pass; the array of one holds the lines, so that they are split once.
    stay = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone"))
    left = F.get(F.transform(F.array(lines), lambda own: F.transform(stay(own), lambda at: F.get(own, at))), F.lit(0))
    text = F.when(F.col("gone").isNull(), t).otherwise(F.array_join(left, "\n"))
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return joined.select(*[(text if c == text_col else F.col(n)).alias(c) for c, n in names.items()], F.size(lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


#: What ``drop_recurring`` does to documents(doc_id, text), with the paths themselves as keys.
SQL = f"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line, list_filter(regexp_split_to_array(u.line, '[\\x09\\x0B-\\x0D\\x20]+'), lambda t: t <> '') AS tokens
  FROM (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(d.l) AS line, unnest(range(len(d.l))) AS pos) u),
paths AS (
  SELECT doc_id, pos, line, CASE WHEN len(tokens) > 0 THEN len(tokens) || ' ' || array_to_string(list_transform(tokens[1:{DEPTH}], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') END AS path
  FROM lines),
recurring AS (SELECT path, min(doc_id) AS first_doc FROM paths WHERE path IS NOT NULL GROUP BY path HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT p.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (r.path IS NOT NULL AND r.first_doc <> p.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (r.path IS NULL OR r.first_doc = p.doc_id), '')) AS kept_sha256
FROM paths p LEFT JOIN recurring r USING (path) GROUP BY p.doc_id
"""
