"""What several training-data operators need: tables in the cluster's shared folder, words and shingle sets."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every other byte, those of multi-byte characters included, stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A word, as a regular expression of Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a default is set only on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return at or "/tmp/checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)  # when the application ends
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are broadcast to a join: about the 10 MB that Spark broadcasts by default.
BROADCAST_IDS = 300_000


def few(rows: DataFrame) -> DataFrame:
    """rows (narrow and stored) marked to be broadcast if their number, which is counted, allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def by_ids(rows: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """rows with (left_semi) or without (left_anti) the ids, by key. Few ids are broadcast, so that texts stay where they
    are; their number is checked, and beyond it both sides are shuffled."""
    return rows.join(few(stored(ids.select(key).distinct(), "ids")), key, how)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows of texts go to Python a few at a time, so that very long texts don't add up in one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs that run send so many rows at a time to Python; afterwards the caller's setting holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def merged(rows: DataFrame, merge: Callable[[list[bytes]], bytes], fan: int = 16) -> bytes | None:
    """What is left when all rows (id int, blob binary; ids from 0 on) are merged, fan at a time, level by level."""

    def run(t: pa.Table) -> pa.Table:
        blobs = sorted(zip(t.column("id").to_pylist(), t.column("blob").to_pylist(), strict=True))
        return pa.table({"id": pa.array([t.column("to")[0].as_py()], pa.int32()), "blob": pa.array([merge([x for _, x in blobs])], pa.binary())})

    rows = stored(rows, "merge")
    while rows.count() > 1:
        rows = stored(rows.withColumn("to", F.floor(F.col("id") / fan).cast("int")).groupBy("to").applyInArrow(run, "id int, blob binary"), "merge")
    found = rows.first()
    return bytes(found.blob) if found else None


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE = [np.uint64(xxhash.xxh64_intdigest(bytes([i])) | 1) for i in range(SHINGLE)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text; with fewer words, of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(len(w), SHINGLE)
    m = len(w) - n + 1
    h = w[:m] * _PLACE[0]
    for i in range(1, n):
        h += w[i : m + i] * _PLACE[i]
    if n < SHINGLE:
        h += np.uint64(n)
    h = mixed(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if m > 1 else h


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
