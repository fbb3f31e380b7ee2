"""From files to the store: text of each kind of file, the nested result of a document, and the whole intake as one batch.

Parsers and a recogniser of names are functions that a caller may give; a text layer, page images and trained models need libraries
that aren't part of this package. Without a recogniser names, dates and places come from rules.
"""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators.client import size_label
from . import files
from .store import Store

GROUPS = {"people": ("PERSON",), "dates": ("DATE", "TIME"), "organizations": ("ORG",), "locations": ("GPE",)}
TIME = r"\b\d{1,2}:\d{2}(?:\s?[AaPp]\.?[Mm]\.?)?"
PLACE = r"\b(?<=\b(?:in|at|from|near) )[A-Z][a-z]+(?:,? [A-Z][a-z]+)*"


def find_ocr(names: tuple[str, ...] = ("tesseract",)) -> str | None:
    """The program that recognises text in images, if one is installed on this machine."""
    return next((found for n in names if (found := shutil.which(n))), None)


def paged(text_layer: Callable[[bytes], list[str]], recognise: Callable[[bytes, int], str] | None = None):
    """A parser for ``files.load``: the text layer of each page, and for pages without one what ``recognise(content, page)`` reads."""
    import pandas as pd

    def parse(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                pages = text_layer(content)
                rows.append((path, [p if p.strip() or recognise is None else recognise(content, i + 1) for i, p in enumerate(pages)]))
            yield pd.DataFrame(rows, columns=["path", "pages"])

    return parse


def unique(values: Column) -> Column:
    """Trimmed strings without blanks and repeats, in the order of their first appearance."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != ""))


def named(body: Column) -> Column:
    """array<struct<text, type>> of the people, organisations, dates, times and places that the rules find."""
    patterns = {"PERSON": lexicon.PERSON, "ORG": f"{lexicon.BODY}|{lexicon.ORGANIZATION}", "DATE": lexicon.DATE, "TIME": TIME, "GPE": PLACE}

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit(kind).alias("type")))

    return F.concat(*[of(kind, pattern) for kind, pattern in patterns.items()])


def structured(entities: Column) -> Column:
    """The texts of array<struct<text, type>> by group, and the array itself."""
    of = lambda kinds: unique(F.transform(F.filter(entities, lambda e: e["type"].isin(*kinds)), lambda e: e["text"]))
    return F.struct(*[of(kinds).alias(group) for group, kinds in GROUPS.items()], entities.alias("entities"))


def processed(documents: DataFrame, chunk_size: int = 500, recognise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """document_id, document, raw_text, cleaned_text, chunks, chunk_count, structured_data, error of documents(document_id, filename,
    path, text). A document without text has an error and no more. ``recognise`` adds ``entities`` to a table with cleaned_text."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    rows = documents.select("document_id", F.struct("filename", "path").alias("document"), F.coalesce("text", F.lit("")).alias("raw_text"), F.when(blank, "no text could be extracted").alias("error"))
    rows = rows.withColumn("cleaned_text", text.clean_text(F.col("raw_text")))
    rows = recognise(rows) if recognise else rows.withColumn("entities", named(F.col("cleaned_text")))
    rows = rows.withColumn("chunks", text.word_chunks(F.col("cleaned_text"), chunk_size))
    return rows.select("document_id", "document", "raw_text", "cleaned_text", "chunks", F.size("chunks").alias("chunk_count"), structured(F.col("entities")).alias("structured_data"), "error")


def intake(store: Store, documents: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Stores documents(document_id, filename, path, text) with all that ``extract`` finds in them: id, filename, status, error of each.

    The rows come first, as one append; what is extracted carries the documents' new ids, so every further table is one append too,
    however many documents there are. Documents of which nothing is extracted get the names that the rules find. At the end the
    rows' metadata say how it went.
    """
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin(*files.TEXT, *files.SCANS, *files.PDF), ext)
    size = size_label(F.octet_length(F.coalesce("text", F.lit(""))))
    body = F.coalesce("text", F.lit(""))
    error = F.when(kind.isNull(), F.concat(F.lit("unsupported file type: ."), ext)).when(F.trim(body) == "", "no text could be extracted")
    rows = documents.withColumn("error", error)
    title = F.regexp_replace("filename", r"\.[A-Za-z0-9]+$", "")
    meta = F.to_json(F.struct(size.alias("size"), F.when(F.col("error").isNull(), "Indexed & Processed").otherwise("Failed").alias("status"), F.lit("Operations").alias("category"), text.preview(body, 240, "…").alias("summary"), "error"))
    new = store.append("documents", rows.select("filename", title.alias("title"), F.col("text").alias("content"), F.col("path").alias("file_path"), F.coalesce(kind, F.lit("")).alias("file_type"), meta.alias("metadata")))
    good = new.where(F.get_json_object("metadata", "$.error").isNull())
    nodes, facts = extract(good.select(F.col("id").cast("string").alias("document_id"), "filename", F.lit(None).cast("array<string>").alias("pages"), F.col("content").alias("text")))
    home = lambda df: df.withColumn("document_id", F.explode(F.array_distinct(F.transform("provenance", lambda p: p["document_id"].cast("bigint")))))
    plain = home(nodes.where("not source_document"))
    said = F.to_json(F.struct(F.lit("extraction").alias("source"), "date_iso"))
    store.append("entities", plain.select("name", F.col("type").alias("entity_type"), "document_id", said.alias("metadata")))
    tail = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    store.append("relationships", home(facts.where("relation <> 'MENTIONED_IN'")).select(tail("source_id").alias("source_entity"), "relation", tail("target_id").alias("target_entity"), "document_id"))
    store.append("decisions", plain.where("type = 'DECISION'").select(F.col("name").alias("title"), "description", "document_id", said.alias("metadata")))
    quotes = nodes.select(F.explode("provenance").alias("p")).select("p.*").distinct()
    store.append("sources", quotes.select(F.col("document_id").cast("bigint"), "filename", F.col("page").cast("bigint").alias("page_number"), F.col("evidence").alias("text")))
    bare = good.join(plain.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")
    rules = bare.select("id", F.explode(F.array_distinct(named(F.col("content")))).alias("e"))
    store.append("entities", rules.select(F.col("e.text").alias("name"), F.col("e.type").alias("entity_type"), F.col("id").alias("document_id"), F.to_json(F.struct(F.lit("document_processing").alias("source"))).alias("metadata")))
    return new.select("id", "filename", F.get_json_object("metadata", "$.status").alias("status"), F.get_json_object("metadata", "$.error").alias("error"))


def main(args: list[str] | None = None) -> int:
    """Files below a path to JSON results; 0 if every document had text, 1 if not or on an error, 130 if interrupted."""
    said = argparse.ArgumentParser(description="Text files to cleaned text, chunks and names as JSON.")
    said.add_argument("path")
    said.add_argument("-o", "--output", default="output")
    said.add_argument("--chunk-size", type=int, default=500)
    try:
        given = said.parse_args(args)
        spark = SparkSession.builder.getOrCreate()
        out = processed(files.load(spark, given.path).where("error is null"), given.chunk_size)
        out.write.mode("overwrite").json(given.output)
        print(json.dumps({"output": given.output, "documents": out.count()}))
        return int(not spark.read.schema("error string").json(given.output).where("error is not null").isEmpty())
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
