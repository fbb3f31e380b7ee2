"""Records as a client shows them: normalised rows, feeds, counters and list operations, all as projections and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview

RECORD = ["id", "name", "date", "timestamp", "size", "type", "category", "summary", "entities", "status"]
CATEGORY, STATUS = "Operations", "Indexed & Processed"


def _given(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in choices])


def size_label(size: Column, blank: str | None = None) -> Column:
    """Bytes as megabytes with one decimal; ``blank`` for nothing."""
    label = F.concat(F.format_string("%.1f", size / F.lit(1024.0 * 1024.0)), F.lit(" MB"))
    return label if blank is None else F.when(size > 0, label).otherwise(blank)


def normalized(documents: DataFrame) -> DataFrame:
    """The client's record of each stored document: what its metadata says, else what the row says, else defaults."""
    meta = lambda k: F.get_json_object(F.coalesce("metadata", F.lit("{}")), f"$.{k}")
    listed = F.coalesce(F.from_json(meta("entities"), "array<string>"), F.array().cast("array<string>"))
    named = lambda e: F.when(e.startswith("{"), _given(F.get_json_object(e, "$.name"), F.get_json_object(e, "$.text"), F.lit("Entity"))).otherwise(e)
    return documents.select(
        F.col("id").cast("string").alias("id"), _given(F.col("filename"), F.lit("Untitled document")).alias("name"), F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("date"),
        (F.unix_micros(F.coalesce(F.col("created_at").cast("timestamp"), F.current_timestamp())) / 1000).cast("long").alias("timestamp"), _given(meta("size"), F.lit("—")).alias("size"),
        F.regexp_replace(F.coalesce("file_type", F.lit("")), r"^([^.]*)\.", "$1").alias("type"), _given(meta("category"), F.lit(CATEGORY)).alias("category"),
        F.coalesce(_given(meta("summary")), preview(F.col("content"), 240, "…")).alias("summary"), F.transform(listed, named).alias("entities"), _given(meta("status"), F.lit(STATUS)).alias("status"),
    )


def synthesized(files: DataFrame) -> DataFrame:
    """A record for each file(id, name, size, at) that was only just given."""
    summary = F.concat(F.lit('Extracted text and structural information from document "'), "name", F.lit('". Integrated into institutional memory database.'))
    return files.select(
        F.concat(F.lit("doc_"), "id").alias("id"), "name", F.date_format("at", "yyyy-MM-dd HH:mm").alias("date"), F.unix_millis(F.col("at").cast("timestamp")).alias("timestamp"), size_label(F.col("size"), "1.5 MB").alias("size"),
        F.lower(F.element_at(F.split("name", r"\."), -1)).alias("type"), F.lit(CATEGORY).alias("category"), summary.alias("summary"), F.array(*[F.lit(x) for x in ("Document Processing", "Vector Index", "Knowledge Entity")]).alias("entities"), F.lit(STATUS).alias("status"),
    )


def filtered(records: DataFrame, query: str = "", category: str | None = None, kind: str | None = None) -> DataFrame:
    """Records by category and type (in any case, 'all' for no filter), with the query in name, summary or an entity."""
    for column, wanted in (("category", category), ("type", kind)):
        if wanted and wanted != "all":
            records = records.where(F.lower(column) == wanted.lower())
    q = query.lower()
    if not q:
        return records
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return records.where(has(F.col("name")) | has(F.col("summary")) | F.exists(F.coalesce("entities", F.array().cast("array<string>")), has))


def results(records: DataFrame) -> DataFrame:
    """What a result list shows."""
    return records.select("name", "summary", "date", "size")


def repository(records: DataFrame) -> DataFrame:
    """What the table of all documents shows."""
    return records.select("id", "name", "date", "summary", "type", "category", "size", "status")


def timeline(records: DataFrame, *more: DataFrame) -> DataFrame:
    """type, title, subtitle, date, timestamp: an activity for each record and what else there is, latest first."""
    said = records.select(F.lit("upload").alias("type"), F.concat(F.lit('Uploaded document "'), "name", F.lit('"')).alias("title"), F.concat(F.lit("Extracted "), F.size("entities"), F.lit(" entities • Category: "), "category").alias("subtitle"), "date", "timestamp")
    for df in more:
        said = said.unionByName(df)
    return said.orderBy(F.desc("timestamp"), "title")


def notifications(documents: DataFrame, limit: int = 10) -> DataFrame:
    """id, title, message, time, read, type of the documents with the largest ids."""
    newest = documents.orderBy(F.desc("id")).limit(limit)
    return newest.select(F.concat(F.lit("doc-"), "id").alias("id"), F.lit("Document Indexed").alias("title"), F.concat("filename", F.lit(" is available in institutional memory.")).alias("message"), F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("time"), F.lit(False).alias("read"), F.lit("success").alias("type"))


def processed(record: DataFrame) -> DataFrame:
    """The notification of a record that was added."""
    return record.select(F.concat(F.lit("notif_"), "timestamp").alias("id"), F.lit("Document Processed").alias("title"), F.concat(F.lit("Document '"), "name", F.lit("' processed successfully into Knowledge Graph.")).alias("message"), F.lit("Just now").alias("time"), F.lit(False).alias("read"), F.lit("success").alias("type"))


def added(records: DataFrame, feed: DataFrame, record: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, notifications) with one more record; lists are ordered by whoever shows them."""
    return records.unionByName(record), feed.unionByName(processed(record))


def removed(records: DataFrame, record_id: str) -> DataFrame:
    return records.where(~F.col("id").eqNullSafe(F.lit(record_id)))


def all_read(feed: DataFrame) -> DataFrame:
    return feed.withColumn("read", F.lit(True))


def unread(feed: DataFrame) -> DataFrame:
    """unread: how many."""
    return feed.agg(F.count_if(~F.coalesce("read", F.lit(False))).alias("unread"))


def counters(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """uploads, entities (of all records, repeats count), nodes."""
    own = records.agg(F.count("*").alias("uploads"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"))
    return own.crossJoin(nodes.agg(F.count("*").alias("nodes")))


def topology(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): records and their entities as a graph of two kinds. Of an entity in several records the first names it; an
    entity with a figure is a metric, one with a known sign of an organisation is one."""
    e = records.select(F.col("id").alias("source"), F.col("name").alias("doc"), F.posexplode("entities").alias("at", "entity"))
    e = e.withColumn("target", F.concat(F.lit("entity_"), F.regexp_replace("entity", r"\s+", "_")))
    kind = F.when(F.col("entity").rlike(r"[$%0-9]"), "metric").when(F.col("entity").rlike("CFO|Kubernetes|Kafka"), "org").otherwise("entity")
    first = e.groupBy("target").agg(F.min(F.struct("source", "at", "entity", "doc")).alias("m")).select(F.col("target").alias("id"), F.col("m.entity").alias("entity"), F.col("m.doc").alias("doc"))
    entities = first.select("id", F.col("entity").alias("label"), kind.alias("type"), F.concat(F.lit('Extracted from "'), "doc", F.lit('"')).alias("description"))
    return records.select("id", F.col("name").alias("label"), F.lit("document").alias("type"), F.col("summary").alias("description")).unionByName(entities), e.select("source", "target")
