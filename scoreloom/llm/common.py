"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.session import scratch, shared_dir

# An odd multiplier (2^64 divided by the golden ratio) that spreads 64-bit numbers.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, the text as its UTF-8 bytes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, key: str) -> str:
    """Name of a new table in the shared folder, bucketed by `key`: later joins on it do not move its rows.

    `drop_stored` removes what a session has stored.
    """
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.write.format("parquet")
        .option("compression", "none")
        .option("path", scratch(spark, name))
        .bucketBy(buckets, key)
        .saveAsTable(name)
    )
    return name


def drop_stored(spark: SparkSession) -> None:
    """Remove the tables `stored` has made in this session, their files included."""
    jvm = spark._jvm
    for table in spark.catalog.listTables():
        if table.name.startswith("stored_") and table.tableType == "EXTERNAL":
            place = spark.sql(f"DESCRIBE EXTENDED {table.name}").where("col_name = 'Location'").first()
            spark.sql(f"DROP TABLE {table.name}")
            path = jvm.org.apache.hadoop.fs.Path(place["data_type"])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and later stages need the room."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def word_hashes(words, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def rolling(values: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """A polynomial hash of every `width` consecutive values (modulo 2^64, then spread)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = values[:n].copy()
    m = np.uint64(multiplier)
    for k in range(1, width):
        total *= m
        total += values[k : k + n]
    total ^= total >> np.uint64(29)
    total *= GOLDEN
    total ^= total >> np.uint64(32)
    return total


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well-spread bijection of 64-bit numbers, one for each seed."""
    x = keys ^ np.uint64((seed * 0x9FB21C651E98DF25 + 0x5851F42D4C957F2D) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions of consecutive pieces, and the piece of every position."""
    starts = np.cumsum(lengths) - lengths
    return starts, np.repeat(np.arange(len(lengths)), lengths)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def batch_of(schema: str | pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )
