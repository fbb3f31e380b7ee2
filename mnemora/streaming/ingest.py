"""Documents from a folder as a stream: each micro-batch is extracted and appended; one run takes what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extraction import extract, union

SCHEMA = "document_id string, filename string, pages array<string>, text string"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """JSON documents below ``source`` to ``target``/nodes and ``target``/facts. A batch that is run again after a failure
    writes to the same folders, so nothing is doubled."""

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()  # both tables read it
        nodes, facts = extract(batch)
        nodes.write.mode("overwrite").parquet(f"{target}/nodes/batch={number}")
        facts.write.mode("overwrite").parquet(f"{target}/facts/batch={number}")
        batch.unpersist()

    stream = spark.readStream.schema(SCHEMA).json(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts) of all batches so far as one graph: entities of several batches are one node."""
    return union(*(spark.read.parquet(f"{target}/{name}").drop("batch") for name in ("nodes", "facts")))
