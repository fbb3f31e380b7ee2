"""Files as documents, and graphs as files."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, SCANS, PDF = ("txt", "md"), ("png", "jpg", "jpeg"), ("pdf",)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text without those that are no part of a character; replacement characters that the bytes really say stay."""
    said, real, mark = content.cast("string"), F.lit("\ufffd"), F.lit("\ufdd0")
    mended = F.replace(F.replace(F.make_valid_utf8(F.replace(said, real, mark)), real, F.lit("")), mark, real)
    return F.when(F.is_valid_utf8(said), said).otherwise(mended)


def load(spark: SparkSession, path: str, parsers: dict | None = None) -> DataFrame:
    """document_id, filename, path, pages, text, error of the files below a path. Text files are decoded as UTF-8; other kinds need a
    parser: {extension: function of an iterator of pandas frames (path, content) that gives (path, pages)}. A file of a kind that
    nothing reads has an error and no text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("filename")
    raw = raw.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    none, pages = F.lit(None).cast("string"), F.lit(None).cast("array<string>").alias("pages")
    text = raw.where(F.col("ext").isin(*TEXT)).select("path", name, pages, decoded(F.col("content")).alias("text"), none.alias("error"))
    for kind, parse in (parsers or {}).items():
        done = raw.where(F.col("ext") == kind).select("path", "content").mapInPandas(parse, "path string, pages array<string>")
        text = text.unionByName(done.select("path", name, "pages", F.array_join("pages", "\n").alias("text"), none.alias("error")))
    unread = raw.where(~F.col("ext").isin(*TEXT, *(parsers or {})))
    why = F.when(F.col("ext").isin(*SCANS, *PDF), "no parser was given for file type: .").otherwise("unsupported file type: .")
    text = text.unionByName(unread.select("path", name, pages, none.alias("text"), F.concat(why, "ext").alias("error")))
    return text.select(F.sha2("path", 256).alias("document_id"), "filename", "path", "pages", "text", "error")


def save_graph(nodes: DataFrame, facts: DataFrame, path: str, form: str = "json") -> None:
    nodes.write.mode("overwrite").format(form).save(f"{path}/nodes")
    facts.write.mode("overwrite").format(form).save(f"{path}/facts")


def load_graph(spark: SparkSession, path: str, like: tuple[DataFrame, DataFrame], form: str = "json") -> tuple[DataFrame, DataFrame]:
    """What ``save_graph`` wrote, with the schemas of another graph."""
    nodes, facts = (spark.read.schema(x.schema).format(form).load(f"{path}/{n}") for x, n in zip(like, ("nodes", "facts"), strict=True))
    return nodes, facts


def load_or_rebuild(spark: SparkSession, path: str, rebuild: Callable[[], tuple[DataFrame, DataFrame]], form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """The graph as ``save_graph`` left it, checked by reading it once; one that is missing, empty or can't be read is made anew by
    ``rebuild`` and saved."""
    like = rebuild()
    try:
        nodes, facts = load_graph(spark, path, like, form)
        if not nodes.isEmpty():
            facts.isEmpty()
            return nodes, facts
    except (PySparkException, Py4JError):
        pass
    save_graph(*like, path, form)
    return load_graph(spark, path, like, form)
