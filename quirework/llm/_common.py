"""Shared folder, materialised tables and batch slicing for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: bytes of text that the numpy kernels take at a time
SLICE_BYTES = 2 << 20
#: words of 64 bits that a broadcast bitmap of keys has at most
BITMAP_WORDS = 1 << 20
_recorded: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = shared.scratch(spark, name)
    for paths in _recorded:
        paths.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded(paths: list[str]):
    """Append the scratch paths made meanwhile to `paths`, for `release`."""
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded.remove(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    while paths:
        shared.remove(spark, paths.pop())


def trimmed(run):
    """A function over batches that gives what it freed back to the machine when its partition ends: workers live on."""

    @functools.wraps(run)
    def with_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return with_trim


def bitmap_words(keys: int) -> int:
    """Words for a bitmap with eight bits or more a key, a power of 2, BITMAP_WORDS at most."""
    words = 1 << 10
    while words * 8 < keys and words < BITMAP_WORDS:
        words *= 2
    return words


def likely(df: DataFrame, keys: DataFrame, hashes: tuple[Column, Column], words: int) -> DataFrame:
    """`df` with __qw_likely: true for every row whose `hashes` (two 64-bit numbers) are among the columns k and k2 of
    `keys`, and for few others; from a bitmap of `words` * 64 bits, which is broadcast, so that other rows needn't be
    shuffled. With far more keys than bits all are likely, and only speed is lost."""
    slot = lambda k, k2: (F.pmod(k, F.lit(words)), F.pmod(k2, F.lit(64)).cast("int"))
    w, bit = slot(F.col("k"), F.col("k2"))
    bits = keys.groupBy(w.alias("__qw_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__qw_bits"))
    w, bit = slot(*hashes)
    found = df.withColumn("__qw_s", w).join(F.broadcast(bits), F.col("__qw_s") == F.col("__qw_w"), "left")
    return found.withColumn("__qw_likely", F.coalesce(F.getbit("__qw_bits", bit) == 1, F.lit(False))).drop("__qw_s", "__qw_w", "__qw_bits")


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, -(-rows // per_partition))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices with at most `limit` bytes in `column`, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < len(col):
            to = int(np.searchsorted(offs, int(offs[at]) + limit, "right")) - 1
            to = min(max(to, at + 1), len(col))
            yield batch.slice(at, to - at)
            at = to


def unit_hash(text: str) -> "F.Column":
    """Two 64-bit hashes of a text column joined in one string key; null for null."""
    return F.when(F.col(text).isNotNull(), F.concat_ws("-", F.hex(F.xxhash64(F.col(text))), F.hex(F.xxhash64(F.lit(7), F.col(text)))))
