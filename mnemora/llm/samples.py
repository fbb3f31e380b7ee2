"""Bounded, reproducible training samples.

Defined cases: rows with a null label or id, and labels without a document, aren't used; of the rows with one id, the text with
the least hash is the one sampled, so that a sample never has more rows than its bound, however often an id is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, texts


def _of(docs: DataFrame, some: DataFrame) -> DataFrame:
    """doc_id, text of the documents with the few ids in ``some``, one row for each."""
    found = texts(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("least"))
    return found.select("doc_id", "least.text")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, value: int, folds: int, held: int, most: int) -> DataFrame:
    """doc_id, text of at most ``most`` documents with this label outside the held-out fold, by the least hash of their ids."""
    known = labels.select(labels["doc_id"].alias("doc_id"), F.col(label).alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & (F.col("y") == value) & (crc_fold("doc_id", folds) != held))
    return _of(docs, known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) of each class."""
    out: list[tuple[str, int]] = []
    for value in (0, 1):
        rows = labelled_rows(docs, labels, label, value, folds, held, per_class).collect()
        out += [(r["text"], value) for r in sorted(rows, key=lambda r: r["doc_id"])]
    return out


def unlabelled_rows(docs: DataFrame, folds: int, held: int, most: int) -> DataFrame:
    """doc_id, text of at most ``most`` documents outside the held-out fold, by the least hash of their ids; no label is read."""
    some = docs.select(docs["doc_id"].alias("doc_id")).where(F.col("doc_id").isNotNull() & (crc_fold("doc_id", folds) != held))
    return _of(docs, some.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
