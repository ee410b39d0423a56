"""Queries over tables of document features: groups, shares, classes, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BINS = [f"{a}-{b}" for a, b in T.LINE_BINS]


def describe(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column in each group."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    out = df.groupBy(key).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return out.select(key, "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def shares(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column's part of the sum of all in each group; null where that is 0."""
    sums = df.groupBy(key).agg(*[F.sum(f"`{c}`").alias(c) for c in columns])
    total = sum((F.col(f"`{c}`") for c in columns[1:]), F.col(f"`{columns[0]}`"))
    return sums.select(key, *[F.try_divide(F.col(f"`{c}`"), total).alias(c) for c in columns])


def homogeneity(parts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The largest share of each group and its column (the first of equal ones)."""
    best = F.greatest(*[F.col(f"`{c}`") for c in columns])
    which = F.coalesce(*[F.when(F.col(f"`{c}`") == best, c) for c in columns])
    return parts.select(key, best.alias("largest"), which.alias("of"))


def words_per_line_class(prefix: str = "words_per_line_"):
    """partially_empty, table, list, running_text or mixed by the shares of lines with few, some and many words."""
    col = lambda names: sum((F.col(f"`{prefix}{n}`") for n in names[1:]), F.col(f"`{prefix}{names[0]}`"))
    share = lambda names: F.try_divide(col(names), F.col("lines"))
    return F.when(F.col("lines") < 10, "partially_empty").when(share(BINS[:2]) > 0.5, "table").when(share(BINS[2:5]) > 0.5, "list").when(share(BINS[5:]) > 0.5, "running_text").otherwise("mixed")


def top(df: DataFrame, value: str, ties: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.desc(value), ties).limit(k)


def first_per_group(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
