"""Document fingerprints by canonical exact digest, in SQL functions only.

A text is normalised (NFKC), case-folded and its white space collapsed; a 128-bit xxhash groups the results, and inside
each bucket with more than one member the canonical bytes themselves are compared. Texts that share a digest but not their
bytes get a suffix, so equal fingerprints always mean equal canonical texts.

Defined cases: null text is the empty text; null ids come after all others, by a hash of their text; rows with equal ids are
ordered by text; an empty table gives an empty result; a table of one row is its own next document; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, texts

#: Ids per block. A block is the unit in which neighbouring documents meet, so it stays small whatever the table's size.
BLOCK = 256
#: Blocks in a group, and groups in a group of groups.
WIDE = 65536
_LEAST = -(2**62)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, runs of white space as one space, trimmed. ASCII texts need no tables."""
    nfkc = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(fold(nfkc(text)))).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85\x1C-\x1F]+", " "))


def wide_digest(canon: Column) -> Column:
    """Two 64-bit xxhashes under different seeds, as one struct."""
    return F.struct(F.xxhash64(canon).alias("a"), F.xxhash64(F.lit("second seed"), canon).alias("b"))


def _hex(digest: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(digest["a"]), 16, "0"), F.lpad(F.hex(digest["b"]), 16, "0")))


def collisions(rows: DataFrame, digest: Callable[[Column], Column] = wide_digest) -> DataFrame:
    """(digest, canon_sha, place): the distinct canonical texts of each bucket that holds more than one, numbered.

    ``rows``: block, key, text, partitioned by block, with a bounded number of rows to a block. Only texts whose bucket has
    several members are shuffled; they are found by lists of keys per block, so ``rows`` itself isn't moved again, and equal
    texts collapse before the shuffle.
    """
    light = rows.select("block", "key", digest(canonical(F.col("text"))).alias("digest"))
    shared = light.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    lists = light.join(apart(shared, "digest"), "digest").groupBy("block").agg(F.collect_set("key").alias("keys"))
    again = rows.join(lists, "block").where(F.array_contains("keys", F.col("key"))).select(canonical(F.col("text")).alias("canon"))
    distinct = again.select(digest(F.col("canon")).alias("digest"), "canon").distinct()
    several = distinct.groupBy("digest").agg(F.count("*").alias("n"), F.collect_list(F.sha2("canon", 256)).alias("shas")).where("n > 1")
    return several.select("digest", F.posexplode(F.array_sort("shas")).alias("place", "canon_sha"))


def _marked(digest: Column, place: Column) -> Column:
    return F.when(F.coalesce(place, F.lit(0)) > 0, F.concat(_hex(digest), F.lit("-"), place.cast("string"))).otherwise(_hex(digest))


def _blocked(docs: DataFrame, block: int) -> tuple[DataFrame, int, int]:
    """(rows, least and greatest block): rows have block, doc_id, text. Null ids stand below all others, in blocks of their own
    by a hash of their text, so that they share no block but with equal texts. Without null ids no text is read for it."""
    low, high, nulls = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")) if nulls else F.col("doc_id").cast("bigint")
    at = F.floor(order / block) + F.when(F.col("doc_id").isNull(), F.lit(_LEAST)).otherwise(F.lit(0))
    low = _LEAST - 2**63 // block if nulls else int(low or 0) // block - 1
    high = int(high) // block + 1 if high is not None else _LEAST + 2**63 // block
    return docs.select(at.alias("block"), "doc_id", "text"), low, high


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, digest=wide_digest) -> DataFrame:
    """doc_id, fingerprint of every row."""
    base = _blocked(texts(docs, id_col, text_col), block)[0].repartition("block")
    rows = base.withColumn("key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("t")))
    found = rows.select("doc_id", canonical(F.col("text")).alias("canon"))
    found = found.select("doc_id", digest(F.col("canon")).alias("digest"), F.sha2("canon", 256).alias("canon_sha"))
    return found.join(collisions(rows, digest), ["digest", "canon_sha"], "left").select("doc_id", _marked(F.col("digest"), F.col("place")).alias("fingerprint"))


def _next_blocks(blocks: DataFrame, low: int, high: int) -> DataFrame:
    """block, next_block: the next lower block that has rows; after the lowest comes the highest. Blocks are grouped by ``WIDE``, the
    groups by as many, and so on until so few are possible between the least and the greatest block: no window sees more rows than
    that, whether ids are dense or spread over all 64 bits."""
    if high - low <= WIDE:
        w = Window.partitionBy(F.lit(0)).orderBy("block")
        last = F.max("block").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return blocks.select("block", F.coalesce(F.lag("block").over(w), last).alias("next_block"))
    grouped = blocks.withColumn("top", F.floor(F.col("block") / WIDE))
    highs = grouped.groupBy("top").agg(F.max("block").alias("high"))
    tops = _next_blocks(highs.select(F.col("top").alias("block")), low // WIDE - 1, high // WIDE + 1)
    tops = tops.join(highs.withColumnRenamed("top", "next_block"), "next_block").select(F.col("block").alias("top"), F.col("high").alias("before"))
    inside = grouped.withColumn("prev", F.lag("block").over(Window.partitionBy("top").orderBy("block")))
    return inside.join(tops, "top").select("block", F.coalesce("prev", "before").alias("next_block"))


def with_next(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, doc_id, text, at, next_text: each document with the next one's text, by descending id; after the last, the first."""
    placed, low, high = _blocked(docs, block)
    base = placed.repartition("block")  # read several times, but moved once: all need the same columns
    w = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.desc(F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.desc("text"))
    chained = base.select("*", F.lead("text").over(w).alias("follows"), F.row_number().over(w).alias("at"))
    heads = chained.where("at = 1").select(F.col("block").alias("next_block"), F.col("text").alias("head"))
    blocks = placed.select("block").distinct()
    heads = _next_blocks(blocks, low, high).join(heads, "next_block").select("block", "head")
    return chained.join(heads, "block").select("block", "doc_id", "text", "at", F.coalesce("follows", "head").alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, digest=wide_digest) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n/2) code points are replaced by the first as many
    of the next document (descending id, circular), and the likeness (1 if equal, else 0) to the edited and the next text."""
    pairs = with_next(texts(docs, id_col, text_col), block)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.when(half > 0, F.substring(F.col("next_text"), F.lit(1), half)).otherwise(""))
    pairs = pairs.withColumn("edited", edited)
    both = pairs.select("block", F.explode(F.array(F.struct(F.struct("doc_id", "at", F.lit(0).alias("kind")).alias("key"), "text"), F.struct(F.struct("doc_id", "at", F.lit(1).alias("kind")).alias("key"), F.col("edited").alias("text")))).alias("r")).select("block", "r.key", "r.text")
    clash = collisions(both, digest)
    rows = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(f"c_{c}") for c in ("text", "edited", "next_text")])
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *[e for c in ("text", "edited", "next_text") for e in (digest(F.col(f"c_{c}")).alias(f"d_{c}"), F.sha2(f"c_{c}", 256).alias(f"s_{c}"))])
    for c in ("text", "edited", "next_text"):
        mine = clash.select(F.col("digest").alias(f"d_{c}"), F.col("canon_sha").alias(f"s_{c}"), F.col("place").alias(f"p_{c}"))
        rows = rows.join(apart(mine, f"d_{c}"), [f"d_{c}", f"s_{c}"], "left")
    mark = {c: _marked(F.col(f"d_{c}"), F.col(f"p_{c}")) for c in ("text", "edited", "next_text")}
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", mark["text"].alias("fingerprint"), mark["edited"].alias("edited_fingerprint"),
        (mark["text"] == mark["edited"]).cast("double").alias("near_edited"), (mark["text"] == mark["next_text"]).cast("double").alias("near_next"),
    )
