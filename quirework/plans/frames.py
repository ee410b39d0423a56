"""The driver's tables as layout documents, in Spark and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out to all cores if its files are fewer pieces than those; a large table stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, line_no (from 0) and text of the lines of `documents`."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


DOC_LINES = """doc_lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM documents)"""


def geo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as text lines with boxes: scan, region, line_no, x, y, w, h, r (right), b (bottom) and base (y of the baseline)."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("scan"),
        F.col("l_returnflag").alias("region"),
        F.row_number().over(w).alias("line_no"),
        (F.col("l_partkey") % 2000).cast("int").alias("x"),
        (F.col("l_linenumber") * 100 + F.col("l_suppkey") % 40).cast("int").alias("y"),
        (100 + 20 * F.floor("l_quantity")).cast("int").alias("w"),
        F.lit(40).alias("h"),
    ).selectExpr("*", "x + w AS r", "y + h AS b", "y + 30 AS base")


GEO_LINES = """geo_lines AS (SELECT *, x + w AS r, y + h AS b, y + 30 AS base FROM (
  SELECT l_orderkey AS scan, l_returnflag AS region,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS line_no,
    CAST(l_partkey % 2000 AS INTEGER) AS x, CAST(l_linenumber * 100 + l_suppkey % 40 AS INTEGER) AS y,
    CAST(100 + 20 * floor(l_quantity) AS INTEGER) AS w, 40 AS h FROM lineitem))"""


def geo_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around the lines of each (scan, region): scan, region, x, y, r, b, w, h, n_lines."""
    return geo_lines(spark, sf_dir).groupBy("scan", "region").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"), F.count("*").alias("n_lines")).selectExpr("*", "r - x AS w", "b - y AS h")


GEO_REGIONS = GEO_LINES + """, geo_regions AS (SELECT *, r - x AS w, b - y AS h FROM (
  SELECT scan, region, min(x) AS x, min(y) AS y, max(r) AS r, max(b) AS b, count(*) AS n_lines FROM geo_lines GROUP BY scan, region))"""
