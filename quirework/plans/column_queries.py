"""Queries over columns and merged lines of `geo_lines`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import columns as C
from ..operators import layout as L
from .frames import GEO_LINES, geo_lines

_WORDS = "case when line_no % 3 = 0 then '12' else concat('text', line_no, '-') end"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return geo_lines(spark, sf).withColumn("text", F.expr(_WORDS))


_TEXT = "CASE WHEN line_no % 3 = 0 THEN '12' ELSE 'text' || line_no || '-' END"


def column_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of the regions taken for columns of their scan."""
    f = C.column_features(_lines(spark, sf), ["scan"], "region")
    return C.with_column_type(f, ["scan"]).select("scan", "region", "n_lines", "has_words", "type")


_TYPES_SQL = rf"""WITH {GEO_LINES}, t AS (SELECT *, {_TEXT} AS text FROM geo_lines),
 f AS (SELECT scan, region, min(x) AS x, min(y) AS y, max(r) AS r, max(b) AS b, count(*) AS n_lines, bool_or(regexp_matches(text, '[\p{{L}}\p{{N}}_]{{2,}}')) AS has_words, bool_or(length(text) > 3) AS longer FROM t GROUP BY scan, region),
 p AS (SELECT *, r - x AS w, b - y AS h, ((max(r) OVER (PARTITION BY scan) - min(x) OVER (PARTITION BY scan)) - 300) / 2 AS fw FROM f),
 q AS (SELECT *, CASE WHEN w < fw - 80 THEN false WHEN h > 2500 THEN true WHEN h / n_lines > 100 THEN false ELSE w > 700 AND n_lines > 30 END AS ful FROM p)
SELECT scan, region, n_lines, has_words, CASE WHEN ful THEN 'full_text' WHEN has_words THEN 'extra_text' WHEN NOT (y <= 600 AND b > 600) AND NOT (b >= 3200 AND y < 3200) AND n_lines <= 4 AND NOT (w > 500 AND h > 150) THEN 'header_footer' WHEN NOT longer THEN 'noise_column' END AS type FROM q"""


def split_columns(spark: SparkSession, sf: str) -> DataFrame:
    lines = geo_lines(spark, sf).select("scan", "line_no", F.col("x") + 30, "y", F.col("r") + 30, "b").toDF("scan", "line_no", "x", "y", "r", "b")
    return C.split_columns(lines, ["scan"]).select("scan", "line_no", "col")


def average_widths(spark: SparkSession, sf: str) -> DataFrame:
    a = C.average_widths(_lines(spark, sf), ["scan", "region"])
    return a.select("scan", "region", *[F.round(c, 4).alias(c) for c in ("char_width", "line_chars", "line_width")])


def merged_lines(spark: SparkSession, sf: str) -> DataFrame:
    m = C.merge_lines(_lines(spark, sf), ["scan", "region"], ["line_no"], remove_break=True)
    return m.select("scan", "region", "text", G.Box.of().text().alias("box"), "n_lines")


_MERGED_SQL = f"""WITH {GEO_LINES}, t AS (SELECT *, {_TEXT} AS text FROM geo_lines), n AS (SELECT *, lead(text) OVER (PARTITION BY scan, region ORDER BY line_no) AS nx FROM t)
SELECT scan, region, string_agg(CASE WHEN text LIKE '%-' AND nx LIKE 't%' THEN left(text, length(text) - 1) ELSE text END, '' ORDER BY line_no) AS text, format('{{}},{{}},{{}},{{}}', min(x), min(y), max(r) - min(x), max(b) - min(y)) AS box, count(*) AS n_lines FROM n GROUP BY scan, region"""


def rendered_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.row_groups(_lines(spark, sf), ["scan"], ["y", "line_no"]).withColumn("char_width", F.lit(25.0))
    return C.rendered(rows, ["scan"]).select("scan", F.col("row").cast("int").alias("row"), "line")


def text_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Heights of each line's text between the upper side of its box and a straight baseline."""
    outline = F.expr("array(struct(x, y), struct(r as x, y), struct(r as x, b as y), struct(x, b as y))")
    base = F.expr("array(struct(x, base as y), struct(r as x, base as y))")
    return geo_lines(spark, sf).select("scan", "line_no", C.text_heights(outline, base).alias("t")).select("scan", "line_no", "t.max", "t.min", "t.mean", "t.median")


QUERIES = {
    "column_types": (column_types, _TYPES_SQL),
    "split_columns": (split_columns, None),
    "average_widths": (average_widths, f"WITH {GEO_LINES}, t AS (SELECT *, {_TEXT} AS text FROM geo_lines) SELECT scan, region, round(sum(w)::DOUBLE / sum(length(text)), 4) AS char_width, round(avg(length(text)), 4) AS line_chars, round(avg(w), 4) AS line_width FROM t GROUP BY scan, region"),
    "merged_lines": (merged_lines, _MERGED_SQL),
    "rendered_rows": (rendered_rows, None),
    "text_heights": (text_heights, f"WITH {GEO_LINES} SELECT scan, line_no, 30 AS max, 30 AS min, 30 AS mean, 30 AS median FROM geo_lines"),
}
