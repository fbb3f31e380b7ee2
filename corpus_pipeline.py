"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next.

Defined cases: null texts are empty; rows with one id are one document, so what is decided for one of them holds for all; rows
without an id can't be named by a decision and stay; an empty table passes through all stages; further columns stay until the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import leaks, lines, pieces, similarity, toxicity
from mnemora.llm.common import drop_staged, staged, table
from mnemora.llm.queries import tokenizer_path


def without(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``scores``; a null id is never among them."""
    return docs.join(scores.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more as toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return without(docs, toxicity.score(docs, model).where("score >= 0.5"))


def _recounted(shorter: DataFrame, docs: DataFrame) -> DataFrame:
    return shorter.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document of each; every document stays."""
    return _recounted(lines.drop_recurring(docs), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), the document with the least id stays."""
    found = similarity.near_components(docs, words=5, percent=80)
    return without(docs, found.where("component_id <> doc_id"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or nearly, go. Of the rest, long lines that are equal in two documents or more
    stay in the first only: copies are gone by now, and would have left their remains if their lines had gone before."""
    clean = staged(without(docs, leaks.leaks(docs, table(spark, sf_dir, "benchmark"))), "clean")
    return _recounted(lines.drop_repeated(clean), docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the ids of its pieces and digests of the round trip."""
    return pieces.round_trip_digests(docs, tokenizer_path()).drop("n_bytes")


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("benchmark decontamination", leak_stage), ("SentencePiece", piece_stage)]

#: Two stages are learned or walk automata; SQL can't express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
