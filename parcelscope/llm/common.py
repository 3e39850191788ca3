"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch handed to Python: texts are long, and a task holds a few batches at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows up to which a written table is sent to every executor; a larger one is joined by shuffling.
BROADCAST_ROWS = 10_000


def join_small(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a written table on a column both have, null equal to null; it is broadcast if a count shows that it has few rows."""
    own = small.withColumnRenamed(key, "joined_key")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    return rows.join(own, F.col(key).eqNullSafe(F.col("joined_key")), how).drop("joined_key")


def crc_class(doc_id: str, classes: int) -> Column:
    """crc32 of the id's decimal text, modulo ``classes``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % classes


_held: dict = {}


def held(name: object, make):
    """A worker's tables of one operator; those of another, which a reused worker may still hold, are given up first."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they end, the worker gives its tables and unused memory back, as it may stay idle beside others."""
    try:
        yield from batches
    finally:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to ``limit`` at most, or hold one item."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, to size partitions; counted, as estimates know nothing of frames that aren't plain files."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
