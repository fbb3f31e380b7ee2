"""What the corpus operators share: the cluster's scratch folder and array-of-bytes helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where that is unset, a fresh folder on this machine if all
    runs here, as in tests; elsewhere an error, as executors can't see each other's folders."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", "") or _OWN.get(app)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN[app] = "file://" + tempfile.mkdtemp(prefix="mnemora-")
    return f"{base.rstrip('/')}/mnemora-{app}"


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back with the same schema. ``codec``: Parquet's
    compression where it isn't the session's."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    # Shuffle files of the steps before go when the driver's collectors find that nothing refers to them any more.
    gc.collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._mnemora_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete what ``staged`` wrote once nothing reads it any more."""
    path = getattr(df, "_mnemora_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt out by another hash of the keys. A table of counts is laid out by the keys that it was counted by; a
    join on them would then have to take a hot key's rows as one piece. With an exchange of its own on either side, Spark may
    split them."""
    return df.repartition(F.hash(F.lit("apart"), *keys))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text (null: empty), under fixed names, so that further columns can't clash."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIFTS, _FACTORS = (np.uint64(31), np.uint64(29), np.uint64(32)), (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (two multiply-xorshift rounds)."""
    x = x ^ (x >> _SHIFTS[0])
    x *= _FACTORS[0]
    x ^= x >> _SHIFTS[1]
    x *= _FACTORS[1]
    x ^= x >> _SHIFTS[2]
    return x


def crc_fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
