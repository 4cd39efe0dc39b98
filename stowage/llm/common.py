"""Helpers shared by the training-data operators: scratch tables, byte-level
words, row keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
#: Words are maximal runs of bytes other than space and \t-\r; bytes.split() has
#: exactly these separators.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only where
    it is unset and the master is local, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="stowage-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


#: Most rows of an Arrow batch. A task holds its batch whole, in the JVM and in
#: Python, and rows are whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, never raises them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: the lineage
    ends here, and lost executors cost no more than their running tasks."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stowage_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a materialized table nothing will read again."""
    path = getattr(df, "_stowage_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column of that exact name, or nulls if there is none."""
    return (F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)).alias(name)


def documents(df: DataFrame) -> DataFrame:
    """Just the columns of documents, whatever else df has."""
    return df.select([column(df, n, k) for n, k in DOCUMENT_COLUMNS])


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def bytes_of(name: str = "text") -> Column:
    """Text as UTF-8 bytes; null as no bytes."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def words(raw: bytes) -> list[bytes]:
    """Words of the text, A-Z lower-cased."""
    return raw.lower().split()


def crc_mod(doc_id: int | None, m: int) -> int:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def crc_mod_col(m: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits (Steele and Vigna's splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
