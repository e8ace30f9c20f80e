"""Shared pieces: tables, durable intermediates, byte-level tokenisation."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of one slice of an Arrow batch; bounds the arrays that a Python worker holds.
SLICE_CHARS = 800_000


#: Rows that a worker turns into Python objects at once. Spark bounds the bytes of the batches themselves.
BATCH_ROWS = 800


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most BATCH_ROWS rows, without copying."""
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(i, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may leave it unset."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """Have Spark delete an execution's shuffle files as soon as it has ended; the session's own setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    The execution's shuffle files go with it: what it has shuffled is not read again, the table is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_textloom_path", None):
            _remove(df.sparkSession, path)


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner", most: int = 500) -> DataFrame:
    """left.join(right, key, how) for a right side with one row per key at most, without gathering left's hot keys.

    counts (key, n): left's rows by key, best materialized. Keys with over 1/most of left's rows, fewer than `most`
    whatever the size, are joined by broadcast; the others by shuffle. Skew joins of Spark go by compressed bytes and
    miss equal rows.
    """
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    if not total or top * most <= total:
        return left.join(right, key, how)
    hot = F.col(key).isin([r[0] for r in counts.where(F.col("n") * most > F.lit(total)).select(key).collect()])
    warm = left.where(hot).join(F.broadcast(right.where(hot)), key, how)
    return warm.unionByName(left.where(~F.coalesce(hot, F.lit(False))).join(right, key, how))


def bitmap(df: DataFrame, col: str, log2: int = 22) -> np.ndarray:
    """A bit for each value of a 64-bit column, at the value's top bits. 2**log2 bits whatever the table's size."""
    place = F.shiftrightunsigned(F.col(col), 64 - log2)
    words = df.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({col}, {64 - log2}) & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(1 << (log2 - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each uint64 value is set; a set bit may be another value's."""
    place = values >> np.uint64(64 - (len(words).bit_length() + 5))
    return (words.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can; numpy's work leaves much of it."""
    with contextlib.suppress(OSError, AttributeError):
        gc.collect()
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(work):
    """A function of Arrow batches that gives freed memory back when it ends.

    Spark keeps workers for later tasks, several to a core, and each would hold what its largest batch took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


class HashCache(dict):
    """bytes -> 64-bit hash, emptied when it has grown to its limit."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values. np.unique() hashes integers, which takes ten times as long."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(lengths: list[int], limit: int = SLICE_CHARS):
    """Ranges of consecutive rows with about `limit` bytes of text each; a longer text stands alone."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def ascii_lower_words(text: bytes) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. bytes.split() splits on just those six characters."""
    return text.lower().split()
