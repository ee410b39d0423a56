"""Mixing sources to target weights by pivotal dependent rounding.

Each unit of a source should occur `copies` times on average, a real number; its whole part is given and the fraction
is rounded so that a source's total comes out exactly (within one). The pivotal method takes two fractions at a time
and moves mass between them at random until one is 0 or 1, leaving every expectation as it was. Units are spread over
buckets by a hash; each bucket leaves one residual at most; the residuals of `FAN_IN` buckets meet in one bucket of the
next level, up to one for each source, which is rounded by chance. The random numbers are hashes of the units, so a
task that runs again decides alike.

A unit is an id within a source: rows that repeat an id and a source get the same number of copies. Defined results: a
null source is a source of its own, a null id an id of its own; a source with target weight 0 or none gets 0 copies; an
empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, partitions_for

UNITS_PER_BUCKET = 20_000
FAN_IN = 64
#: with more sources than this, units are joined with them by a shuffle
BROADCAST_SOURCES = 100_000
SEED = 7
#: exponent of the flattened source shares
ALPHA = 0.8
_EPS = 1e-9


def pivotal(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions `p` in order with the random numbers `u`; (rounded values, index of the residual or -1).

    The residual's value is what is left of its fraction; all others are 0 or 1.
    """
    p = p.astype(float).copy()
    at = -1
    for k in range(len(p)):
        if p[k] <= _EPS or p[k] >= 1 - _EPS:
            p[k] = round(p[k])
            continue
        if at < 0:
            at = k
            continue
        a, b = p[at], p[k]
        s = a + b
        if s < 1 - _EPS:  # one takes all, the other is 0
            if u[k] * s < a:
                p[at], p[k] = s, 0.0
            else:
                p[at], p[k], at = 0.0, s, k
        elif s <= 1 + _EPS:
            p[at], p[k] = (1.0, 0.0) if u[k] < a else (0.0, 1.0)
            at = -1
        else:  # one becomes 1, the other keeps the rest
            if u[k] * (2 - s) < 1 - b:
                p[at], p[k], at = 1.0, s - 1, k
            else:
                p[at], p[k] = s - 1, 1.0
    return p, at


def _rounder(last: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("id", "ascending")])
        u = group["u"].to_numpy()
        values, at = pivotal(group["p"].to_numpy(), u)
        if at >= 0 and last:
            values[at] = float(u[at] < values[at])
            at = -1
        left = group.select(["source", "id", "base", "bucket", "h", "u"])
        return left.append_column("p", pa.array(values)).append_column("open", pa.array(np.arange(len(values)) == at))

    return run


def _uniform(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / float(1 << 52)


def flattened_weights(counts: dict, alpha: float = ALPHA) -> dict:
    """Target weights in proportion to the sources' sizes to the power `alpha`, summing to 1."""
    w = {s: c**alpha for s, c in counts.items()}
    total = sum(w.values()) or 1.0
    return {s: x / total for s, x in w.items()}


def source_counts(docs: DataFrame, source_col: str = "source") -> dict:
    return {r[0]: r[1] for r in docs.groupBy(source_col).count().collect()}


def total_without_loss(counts: dict, weights: dict) -> float:
    """The smallest number of rows at the target weights at which each source with a weight has 1 copy a row or more."""
    return max([c / weights[s] for s, c in counts.items() if weights.get(s, 0) > 0], default=0.0)


def copies(docs: DataFrame, weights: dict, total: float, *, counts: dict | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """source, id and copies (integer) of every unit, so that the copies of a source's rows sum to weight * total.

    `weights`: source -> share of the result. The number of sources is taken to fit the driver.
    """
    spark = docs.sparkSession
    counts = source_counts(docs, source_col) if counts is None else counts
    ids = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"))
    expected = [(s, float(weights.get(s, 0.0)) * total / n) for s, n in counts.items()]
    source_type, id_type = ids.schema["source"].dataType.simpleString(), ids.schema["id"].dataType.simpleString()
    table = spark.createDataFrame(expected, f"s {source_type}, e double")  # a row for each source
    if len(expected) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    buckets = partitions_for(sum(counts.values()), UNITS_PER_BUCKET)
    units = (
        ids.distinct()
        .join(table, ids.source.eqNullSafe(table.s))
        .select("source", "id", F.floor(F.col("e") + _EPS).cast("int").alias("base"), (F.col("e") - F.floor(F.col("e") + _EPS)).alias("p"), F.xxhash64(F.lit(seed), "source", "id").alias("h"))
        .withColumn("u", _uniform(F.lit(seed + 1), F.col("h"), F.col("id")))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 2), "h"), F.lit(buckets)))
    )
    schema = f"source {source_type}, id {id_type}, base int, bucket long, h long, u double, p double, open boolean"
    decided, level = [], 0
    while True:
        last = buckets == 1
        done = materialise(units.groupBy("source", "bucket").applyInArrow(_rounder(last), schema), f"mix-{level}")
        decided.append(done.where("not open"))
        if last:
            break
        level += 1
        buckets = partitions_for(buckets, FAN_IN)
        units = done.where("open").withColumn("bucket", F.pmod(F.col("bucket"), F.lit(buckets))).withColumn("u", _uniform(F.lit(seed + 3 + level), F.col("h"), F.col("id"))).drop("open")
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("source", "id", (F.col("base") + F.round("p").cast("int")).alias("copies"))


def repeat_rows(docs: DataFrame, decided: DataFrame, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, all columns, each as often as `decided` says."""
    n = "__qw_copies"
    d = decided.select(F.col("source").alias("__qw_source"), F.col("id").alias("__qw_id"), F.col("copies").alias(n)).where(f"{n} > 0")
    joined = docs.join(d, docs[id_col].eqNullSafe(d["__qw_id"]) & docs[source_col].eqNullSafe(d["__qw_source"]))
    return joined.select(*[joined[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).drop(n)


def query(spark, sf_dir: str) -> DataFrame:
    """Copies of every document when source shares are flattened by ALPHA and no source loses rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = source_counts(docs)
    weights = flattened_weights(counts)
    return copies(docs, weights, total_without_loss(counts, weights), counts=counts).withColumnRenamed("id", "doc_id")


QUERY, ORACLE = ("op7_pivotal_mixing", query), None
