"""What several corpus operators share: the shared scratch folder, word rules, Arrow helpers."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is the cluster's spark.checkpoint.dir; only where that is
    unset (tests, a laptop) a folder under the warehouse is used, and set as checkpoint folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Whether Spark deletes a query's shuffle files when it has ended.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there, so a lost
    executor never forces more than the stage in flight to be computed again. The shuffle files of the
    query that wrote go when it has ended; `discard` deletes the table when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gabbro/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(FREE)
    spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for mine in _made:
        mine.append(out)
    return out


_made: list[list[DataFrame]] = []


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that `written` makes inside, for `discard` of those that no result needs."""
    mine: list[DataFrame] = []
    _made.append(mine)
    try:
        yield mine
    finally:
        _made.pop()


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written`. Only for tables that no lazy result still reads."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)  # noqa: SLF001
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def buckets_for(df: DataFrame, each: int) -> int:
    """Into how many buckets to deal what is made from df, at `each` bytes of its size as the optimizer knows
    it from file sizes: a task's share stays the same whatever the corpus. At least the shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), 1 << 20))


def release() -> None:
    """Gives freed memory back to the system. Python workers live on from task to task, and what the C
    library and Arrow keep of one task's arrays would count beside the next one's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of each string; null counts as empty."""
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def flat_utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as numpy views; a null has no bytes."""
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_counts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words (WORD) in each slice of flat."""
    if not len(flat):
        return np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[flat]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    total = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(batch: pa.RecordBatch, col: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that col holds at most about max_bytes in each part (one row at least)."""
    _, off = flat_utf8(batch.column(col))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * M2
        x = (x ^ (x >> np.uint64(29))) * M1
        return x ^ (x >> np.uint64(32))


def text_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, by exact name: extra columns can't clash later."""
    return df.select(*[F.col(n) for n in names])
