"""The relational tables as Parquet folders under a log of commits: appends, copy-on-write updates, cascading deletes, and reads.

A commit is a numbered JSON file that names, for every table, the folders that it consists of and the highest id ever given. The
commit with the highest number is the state of all tables, so readers see a change of several tables at once or not at all, a
deleted id is never given again, and an append writes only what it adds. Each writer writes into folders of its own; of two that
commit at once the second finds the number taken, and tries again on the new state. Changed rows rewrite only the folders they are in.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "id bigint, filename string, title string, content string, file_path string, file_type string, created_at timestamp_ntz, metadata string",
    "entities": "id bigint, name string, entity_type string, document_id bigint, metadata string",
    "relationships": "id bigint, source_entity string, relation string, target_entity string, document_id bigint, metadata string",
    "decisions": "id bigint, title string, description string, reason string, date string, meeting string, document_id bigint, metadata string",
    "sources": "id bigint, document_id bigint, filename string, page_number bigint, text string, source_type string, metadata string",
}
REQUIRED = {"documents": ["filename"], "entities": ["name", "entity_type"], "relationships": ["source_entity", "relation", "target_entity"], "decisions": ["title"], "sources": []}
DEFAULTS = {"title": "", "content": "", "file_path": "", "file_type": "", "metadata": "{}", "source_type": "document"}


class Conflict(RuntimeError):
    """Other writers committed first, again and again."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict]:
        """The last commit's number (-1: none) and what it says: {table: {"folders": [...], "top": highest id}}."""
        log, fs = self._path("_log")
        numbers = [int(n[:-5]) for x in fs.listStatus(log) if (n := x.getPath().getName()).endswith(".json")] if fs.exists(log) else []
        if not numbers:
            return -1, {t: {"folders": [], "top": 0} for t in SCHEMAS}
        file, fs = self._path("_log", f"{max(numbers):012d}.json")
        stream = fs.open(file)
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, state: dict) -> bool:
        """False if that number is taken."""
        file, fs = self._path("_log", f"{number:012d}.json")
        if fs.exists(file):
            return False
        whole, fs = self._path("_log", f"_{uuid.uuid4().hex}")
        stream = fs.create(whole, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        done = not fs.exists(file) and fs.rename(whole, file)  # a half-written commit is never seen
        if not done:
            fs.delete(whole, False)
        return done

    def _change(self, make) -> bool:
        """Commits ``make(state)``, a new state or None for nothing to do; again if others came first."""
        for _ in range(8):
            number, state = self._state()
            new = make(state)
            if new is None:
                return False
            if self._commit(number + 1, new):
                return True
        raise Conflict(self.root)

    def _write(self, table: str, df: DataFrame) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def _table(self, state: dict, table: str) -> DataFrame:
        folders = [f"{self.root}/{x}" for x in state[table]["folders"]]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[table])

    def _rewritten(self, state: dict, table: str, hit: Column, change) -> dict:
        """The table's entry after ``change`` (of a DataFrame), with only the folders rewritten that hold rows where ``hit``."""
        own = state[table]
        touched = [x for x in own["folders"] if not self._table({table: {"folders": [x]}}, table).where(hit).isEmpty()]
        if not touched:
            return own
        new = self._write(table, change(self._table({table: {"folders": touched}}, table)))
        return {"folders": [x for x in own["folders"] if x not in touched] + [new], "top": own["top"]}

    def initialize(self) -> None:
        """Makes the tables that aren't there."""
        if self._state()[0] < 0:
            self._commit(0, self._state()[1])

    def read(self, table: str) -> DataFrame:
        return self._table(self._state()[1], table)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Adds rows with new ids above all that were ever given, and returns them; required strings are trimmed and blank ones
        refused."""
        have = set(rows.columns)
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        for c in REQUIRED[table]:
            if c not in have:
                raise ValueError(f"{table} needs {c}")
            rows = rows.withColumn(c, F.trim(c)).where(F.coalesce(F.col(c), F.lit("")) != "")
        cols = []
        for f in schema:
            if f.name == "created_at":
                now = F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")
                cols.append((F.coalesce(F.col("created_at").cast("timestamp_ntz"), now) if "created_at" in have else now).alias("created_at"))
            elif f.name != "id":
                value = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
                cols.append((F.coalesce(value, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else value).alias(f.name))
        # Numbers without one task for all: the rows before a partition are counted first.
        coming = f"{self.root}/_incoming/{uuid.uuid4().hex}"
        rows.select(*cols).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()).write.parquet(coming)
        marked = self.spark.read.parquet(coming)
        counts = marked.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c"))
        total = marked.count()
        at = F.row_number().over(Window.partitionBy("_p").orderBy("_k"))
        numbered = marked.join(F.broadcast(counts), "_p").withColumn("n", at + F.col("_before"))
        added: list[str] = []

        def grown(state: dict) -> dict:
            own = state[table]
            added[:] = [self._write(table, numbered.withColumn("id", (F.col("n") + F.lit(own["top"])).cast("bigint")).select(*[f.name for f in schema]))]
            return {**state, table: {"folders": own["folders"] + added, "top": own["top"] + total}}

        self._change(grown)
        path, fs = self._path("_incoming", coming.rsplit("/", 1)[1])
        fs.delete(path, True)
        return self._table({table: {"folders": added}}, table)

    def update_document(self, doc_id: int, **values) -> bool:
        """Sets the values that aren't None; False if nothing is given or there is no such row."""
        values = {k: v for k, v in values.items() if v is not None}
        hit = F.col("id") == doc_id

        def change(df: DataFrame) -> DataFrame:
            return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})

        def updated(state: dict) -> dict | None:
            own = self._rewritten(state, "documents", hit, change) if values else state["documents"]
            return None if own is state["documents"] else {**state, "documents": own}

        return self._change(updated)

    def delete_document(self, doc_id: int) -> bool:
        """Deletes a document with its entities, relationships and sources, and takes its decisions' reference to it away, in one
        commit."""
        own = F.col("document_id") == doc_id

        def deleted(state: dict) -> dict | None:
            docs = self._rewritten(state, "documents", F.col("id") == doc_id, lambda df: df.where(F.col("id") != doc_id))
            if docs is state["documents"]:
                return None
            rest = {t: self._rewritten(state, t, own, lambda df: df.where(~F.col("document_id").eqNullSafe(F.lit(doc_id)))) for t in ("entities", "relationships", "sources")}
            without = lambda df: df.withColumn("document_id", F.when(F.col("document_id") != doc_id, F.col("document_id")))
            return {**state, **rest, "documents": docs, "decisions": self._rewritten(state, "decisions", own, without)}

        return self._change(deleted)

    def document(self, doc_id: int) -> DataFrame:
        return self.read("documents").where(F.col("id") == doc_id)

    def newest(self, table: str, document_id: int | None = None, limit: int | None = None) -> DataFrame:
        """Rows by descending id, of one document if given; a limit is clamped to 1..500."""
        df = self.read(table)
        if document_id is not None:
            df = df.where(F.col("document_id") == document_id)
        df = df.orderBy(F.desc("id"))
        return df if limit is None else df.limit(max(1, min(500, limit)))

    def persist(self, document_id: int, nodes: DataFrame, facts: DataFrame) -> None:
        """An extraction as rows: entities, relationships by the names in their nodes' ids, decisions, and sources."""
        d = F.lit(document_id).cast("bigint")
        origin = F.lit("extraction").alias("source")
        self.append("entities", nodes.where("not source_document").select("name", F.col("type").alias("entity_type"), d.alias("document_id"), F.to_json(F.struct(origin, "date_iso")).alias("metadata")))
        named = lambda c: F.regexp_replace(c, "^[^:]*:", "")
        self.append("relationships", facts.where("relation <> 'MENTIONED_IN'").select(named("source_id").alias("source_entity"), "relation", named("target_id").alias("target_entity"), d.alias("document_id"), F.to_json(F.struct(origin)).alias("metadata")))
        when = facts.where("relation = 'DECIDED_ON'").groupBy(F.col("source_id").alias("id")).agg(F.min("date_iso").alias("date"))
        why = facts.where("relation = 'JUSTIFIED_BY'").join(nodes.select(F.col("id").alias("target_id"), F.col("name").alias("reason")), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.min("reason").alias("reason"))
        dec = nodes.where("type = 'DECISION'").join(when, "id", "left").join(why, "id", "left").select(F.col("name").alias("title"), "description", "reason", "date", d.alias("document_id"), F.to_json(F.struct(origin, "date_iso")).alias("metadata"))
        self.append("decisions", dec)
        said = nodes.select(F.explode("provenance").alias("p")).select("p.*").distinct()
        self.append("sources", said.select(d.alias("document_id"), "filename", F.col("page").cast("bigint").alias("page_number"), F.col("evidence").alias("text")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table that is needed for a while: in the cluster's shared folder, or on this machine if all runs here."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mnemora-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
