"""Helpers that the training-data operators share.

Heavy text work runs in Arrow batches.  Two habits keep it bounded and cheap:

* texts are gathered into *blocks* of a few megabytes, so NumPy works on arrays
  that fit a cache and a task never holds its partition;
* numbers that have to be shuffled (hashes, ids, counts) travel as packed
  binary columns, a row for each (block, bucket), not as a row for each number.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="voxloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


_scopes: list[list[str]] = []


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the
    lineage, survives lost executors and is never computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables written inside, but for those written with what it
    yields: an operator of many steps leaves its result, not its steps."""
    _scopes.append([])

    def result(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        _scopes[-1].pop()
        return out

    try:
        yield result
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of earlier steps that nothing refers to."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of text whose keys a bucket of a packed shuffle holds: it fits a worker at any size of the input.
BUCKET_TEXT = 16 << 20


def bucket_count(rows: DataFrame, text_col: str = "text") -> int:
    """Buckets of a packed shuffle over the texts of ``rows``: a power of 2 that
    follows their bytes, which are counted first."""
    n_bytes = rows.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(8, 1 << max(0, -(-n_bytes // BUCKET_TEXT) - 1).bit_length())


def by_bucket(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Each bucket in a partition of its own, so that no two large ones share a task."""
    return rows.repartitionById(n_buckets, F.col("bucket"))


def part_of(number: int, parts: int) -> int:
    """The part that a task's ``number``-th block goes to: blocks of one task and
    of neighbouring tasks spread evenly, and a rerun task gives the same."""
    task = TaskContext.get()
    return ((task.partitionId() if task else 0) + 37 * number) % parts


def by_part(rows: DataFrame, parts: int) -> GroupedData:
    """Rows (part, block, ...) dealt by part and grouped by block."""
    return rows.repartitionById(parts, F.col("part")).groupBy("part", "block")


def steady(rows: DataFrame) -> DataFrame:
    """``rows`` that a rerun task reads in the same order.

    What is read twice has to fall into the same blocks.  Files do; rows behind
    a shuffle may arrive in another order after an executor is lost, so they
    are written first.
    """
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        return written(rows, "steady")
    return rows


def byte_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its n + 1 offsets, nulls as
    empty; no Python string is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def blocks(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Regroups batches so that ``column`` holds about ``limit`` bytes in each,
    a longer value alone; rows keep their order.  Memory is trimmed between."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_buffers(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            room = limit - size
            stop = int(np.searchsorted(offsets, offsets[start] + room, "right")) - 1
            if stop <= start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(offsets[stop] - offsets[start])
            if stop < batch.num_rows:
                yield joined(held)
                held, size = [], 0
                trim()
            start = max(stop, start)
    if held:
        yield joined(held)
    held = []
    trim()


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of several."""
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it has no trim
        return None


def trim() -> None:
    """Gives freed memory back to the system.  A Python worker lives through
    many stages; what its allocators keep would add up over them."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every (start, count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total, dtype=np.int64)


def binary(values: list[bytes]) -> pa.Array:
    """A binary column; an empty list too gets the right type."""
    return pa.array(values, pa.binary())


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text (null: empty), under names of our own: other
    columns of the table cannot clash and are never read."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
