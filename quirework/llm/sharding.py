"""Sharding by jump consistent hashing.

A 64-bit key jumps through a linear congruential sequence to the last bucket below the number of shards; no ring table
is needed. When shards are appended, a key either stays or moves to one of the new shards: of n -> m shards, the
fraction 1 - n/m moves and nothing else.

Defined results: a null key has no shard (null); equal keys, and so repeated rows, share a shard; an empty table gives
an empty result; other columns are kept or passed over as the function says. Integer keys are used as they are, other
types through xxhash64 of the value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LCG = np.uint64(2862933555777941757)
SHARDS, GROWN = 4096, 5120


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key (int64 array), int32."""
    if shards < 1:
        raise ValueError("the number of shards must be at least 1")
    key = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    active = np.arange(len(key))
    j = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(active):
            out[active] = j
            key = key * _LCG + np.uint64(1)
            j = np.floor((out[active] + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            on = j < shards
            active, key, j = active[on], key[on], j[on]
    return out.astype(np.int32)


def _key(df: DataFrame, col: str) -> Column:
    if isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(col).cast("long")
    return F.when(F.col(col).isNotNull(), F.xxhash64(F.col(col)))


def assign(df: DataFrame, key_col: str, shards: dict[str, int]) -> DataFrame:
    """The key column and, for each name in `shards`, the shard among that many."""
    names = list(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = np.asarray(b.column(1).is_null())
            keys = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(jump(keys, shards[n]), mask=null) for n in names)], [key_col, *names])

    key_type = df.schema[key_col].dataType.simpleString()
    return df.select(F.col(key_col).alias("v"), _key(df, key_col).alias("k")).mapInArrow(run, ", ".join([f"`{key_col}` {key_type}", *(f"`{n}` int" for n in names)]))


def write_shards(df: DataFrame, key_col: str, shards: int, path: str, *, shard_col: str = "shard") -> None:
    """Write `df` with all its columns, one folder for each shard; rows with a null key go to Spark's null folder.

    A column that is called like `shard_col` (any case) is refused, as the folder names would hide it. Shards are written
    by range, so that a task writes few folders and a large shard is split among several tasks.
    """
    if shard_col.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {shard_col}; give another shard_col")

    @F.pandas_udf("int")
    def shard(k):
        import pandas as pd

        null = k.isna().to_numpy()
        # a pandas column with nulls holds floats, which can't carry 64 bits; so the key comes as two halves
        return pd.Series(jump(np.where(null, 0, k.fillna("0")).astype(np.int64), shards)).astype("Int32").mask(null)

    (df.withColumn(shard_col, shard(_key(df, key_col).cast("string"))).repartitionByRange(shard_col, F.xxhash64(key_col)).write.partitionBy(shard_col).parquet(path))


def query(spark, sf_dir: str) -> DataFrame:
    """Shard of every document among SHARDS, and among GROWN when shards are appended."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = assign(docs, "doc_id", {"shard": SHARDS, "shard_grown": GROWN})
    return out.withColumn("moved", F.col("shard") != F.col("shard_grown"))


def _walk(shards: int, name: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, (CASE WHEN doc_id < 0 THEN 18446744073709551616::UHUGEINT - (-doc_id)::UHUGEINT ELSE doc_id::UHUGEINT END) AS k,
         -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, nk, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592::UHUGEINT) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT doc_id, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS nk, j FROM {name} WHERE j < {shards}))"""


ORACLE = f"""WITH RECURSIVE {_walk(SHARDS, "w1")}, {_walk(GROWN, "w2")},
 s1 AS (SELECT doc_id, max(b) AS shard FROM w1 GROUP BY doc_id), s2 AS (SELECT doc_id, max(b) AS shard_grown FROM w2 GROUP BY doc_id)
SELECT d.doc_id, CAST(shard AS INTEGER) AS shard, CAST(shard_grown AS INTEGER) AS shard_grown, shard <> shard_grown AS moved
FROM documents d LEFT JOIN s1 ON s1.doc_id = d.doc_id LEFT JOIN s2 ON s2.doc_id = d.doc_id"""
QUERY = ("op4_jump_sharding", query)
