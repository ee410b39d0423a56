"""Queries over documents' features by inventory (the column source): SQL from text_queries' features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import doc_stats as D
from ..operators import inventory as I
from .frames import doc_lines, table
from .text_queries import _ALL, _LINE, _WIDTH

_NAMES = ["num_words", "num_title_words", "num_oversized_words", *[n for n in _ALL if n.startswith(("num_words_length", "words_per_line", "line_width"))]]
_WIDTHS = [n for n in _ALL if n.startswith("line_width")]


def features(spark: SparkSession, sf: str) -> DataFrame:
    """A row of features for each document, with its source, language, length and number in its source."""
    lines = doc_lines(spark, sf).withColumn("width", F.length("text") * _WIDTH)
    stats = D.doc_stats(lines, ["doc_id", "source", "lang"], width="width")
    w = Window.partitionBy("source").orderBy("doc_id")
    return stats.withColumn("num", F.row_number().over(w))


def _sql(tail: str) -> str:
    cols = ", ".join(f'CAST(sum({_ALL[n]}) AS BIGINT) AS "{n}"' for n in _NAMES)
    return f"""WITH {_LINE}, s0 AS (SELECT doc_id, source, lang, CAST(count(*) AS BIGINT) AS lines, {cols} FROM f GROUP BY doc_id, source, lang),
 s AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS num FROM s0) {tail}"""


def inventory_describe(spark: SparkSession, sf: str) -> DataFrame:
    d = I.describe(features(spark, sf), "source", "num_words")
    return d.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


_DESCRIBE = """SELECT source, count(*) AS count, round(avg(num_words), 4) AS mean, round(stddev_samp(num_words), 4) AS std, min(num_words) AS min, round(quantile_cont(num_words, 0.25), 4) AS q25,
  round(quantile_cont(num_words, 0.5), 4) AS q50, round(quantile_cont(num_words, 0.75), 4) AS q75, max(num_words) AS max FROM s GROUP BY source"""
_SUM = " + ".join(f'sum("{c}")' for c in _WIDTHS)
_SHARES = "SELECT source, " + ", ".join(f'sum("{c}") / ({_SUM}) AS "{c}"' for c in _WIDTHS) + " FROM s GROUP BY source"


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return I.shares(features(spark, sf), "source", _WIDTHS)


def inventory_line_share(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf).select("source", *[F.round(f"`{c}`", 5).alias(c) for c in _WIDTHS])


def inventory_homogeneity(spark: SparkSession, sf: str) -> DataFrame:
    h = I.homogeneity(_shares(spark, sf), "source", _WIDTHS)
    return h.select("source", F.round("largest", 5).alias("largest"), "of")


_HOMOGENEITY = f"""SELECT source, round(greatest({", ".join(f'"{c}"' for c in _WIDTHS)}), 5) AS largest, CASE {" ".join(f"WHEN " + chr(34) + c + chr(34) + f" = greatest({', '.join(chr(34) + x + chr(34) for x in _WIDTHS)}) THEN '{c}'" for c in _WIDTHS)} END AS "of" FROM h"""


def docs_per_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the number of documents of its inventory."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    # counted before the shuffle; a row for each inventory then meets the documents, which lie where they are if it is small
    many = docs.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("docs"))
    return docs.join(many, F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "source", "docs")


def classify_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Shape of a document taken for a page: a line is 40 high, the longest line is its width."""
    from ..functions.geometry import shape

    sizes = doc_lines(spark, sf).groupBy("doc_id").agg((F.max(F.length("text")) * 10).alias("w"), (F.count("*") * 40).alias("h"))
    return sizes.select("doc_id", shape(F.try_divide("w", F.col("h"))).alias("shape"))


def subset_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Means of features over documents of good and of bad quality."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    j = features(spark, sf).join(labels, "doc_id")
    return j.groupBy("quality").agg(F.count("*").alias("docs"), F.round(F.avg("lines"), 4).alias("lines"), F.round(F.avg("num_words"), 4).alias("words"), F.round(F.avg("num_title_words"), 4).alias("title_words"))


_LONG = ["num_words_length_25", "num_words_length_30", "num_oversized_words"]


def long_word_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents with the most words of more than 20 letters."""
    f = features(spark, sf).select("doc_id", sum((F.col(c) for c in _LONG[1:]), F.col(_LONG[0])).alias("long_words"))
    return I.top(f, "long_words", "doc_id")


def document_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each inventory by language: one entry for each language of the table, also where there are none."""
    docs = table(spark, sf, "documents").select("source", F.coalesce("lang", F.lit("?")).alias("lang"))
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())  # a row for each language
    p = docs.groupBy("source").pivot("lang", langs).agg(F.count(F.lit(1))).na.fill(0, langs)
    return p.select("source", F.concat_ws(" ", *[F.concat(F.lit(f"{v}:"), F.col(f"`{v}`")) for v in langs]).alias("docs"))


def hierarchy_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and words of the whole corpus, of inventories, and of their languages."""
    f = features(spark, sf).rollup("source", "lang").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("docs"), F.sum("num_words").alias("words"))
    return f.select("source", "lang", "level", "docs", "words")


_CLASS = (
    """CASE WHEN lines < 10 THEN 'partially_empty' WHEN ({t})::DOUBLE / lines > 0.5 THEN 'table' WHEN ({l})::DOUBLE / lines > 0.5 THEN 'list' WHEN ({r})::DOUBLE / lines > 0.5 THEN 'running_text' ELSE 'mixed' END"""
).format(**{k: " + ".join(f'"words_per_line_{n}"' for n in names) for k, names in {"t": I.BINS[:2], "l": I.BINS[2:5], "r": I.BINS[5:]}.items()})

QUERIES = {
    "inventory_describe": (inventory_describe, _sql(_DESCRIBE)),
    "inventory_line_share": (inventory_line_share, _sql(", h AS (" + _SHARES + ") SELECT source, " + ", ".join(f'round("{c}", 5) AS "{c}"' for c in _WIDTHS) + " FROM h")),
    "inventory_homogeneity": (inventory_homogeneity, _sql(f", h AS ({_SHARES}) {_HOMOGENEITY}")),
    "docs_per_inventory": (docs_per_inventory, "SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS docs FROM documents"),
    "top_docs_by_words": (lambda s, d: I.top(features(s, d).select("doc_id", "num_words"), "num_words", "doc_id"), _sql("SELECT doc_id, num_words FROM s ORDER BY num_words DESC, doc_id LIMIT 10")),
    "top_docs_by_lines": (lambda s, d: I.top(features(s, d).select("doc_id", "lines"), "lines", "doc_id"), _sql("SELECT doc_id, lines FROM s ORDER BY lines DESC, doc_id LIMIT 10")),
    "first_doc_per_inventory": (lambda s, d: I.first_per_group(features(s, d).where("num_words > 100").select("source", "doc_id", "num_words"), "source", "doc_id"), _sql("SELECT source, doc_id, num_words FROM s WHERE num_words > 100 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")),
    "classify_shape": (classify_shape, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), z AS (SELECT doc_id, max(length(t)) * 10 / (count(*) * 40) AS q FROM l GROUP BY doc_id) SELECT doc_id, CASE WHEN q < 0.9 THEN 'portrait' WHEN q > 1.1 THEN 'landscape' ELSE 'square' END AS shape FROM z"),
    "classify_words_per_line": (lambda s, d: features(s, d).select("doc_id", I.words_per_line_class().alias("class")), _sql(f"SELECT doc_id, {_CLASS} AS class FROM s")),
    "subset_compare": (subset_compare, _sql("SELECT quality, count(*) AS docs, round(avg(lines), 4) AS lines, round(avg(num_words), 4) AS words, round(avg(num_title_words), 4) AS title_words FROM s JOIN labels USING (doc_id) GROUP BY quality")),
    "long_word_outliers": (long_word_outliers, _sql(f"SELECT doc_id, {' + '.join(_LONG)} AS long_words FROM s ORDER BY long_words DESC, doc_id LIMIT 10")),
    "range_filter": (lambda s, d: features(s, d).where("num between 20 and 60").select("source", "num", "doc_id", "lines"), _sql("SELECT source, num, doc_id, lines FROM s WHERE num BETWEEN 20 AND 60")),
    "document_matrix": (document_matrix, """WITH d AS (SELECT source, coalesce(lang, '?') AS lang FROM documents), c AS (SELECT source, lang, count(*) AS n FROM d GROUP BY source, lang)
SELECT s.source, string_agg(l.lang || ':' || coalesce(c.n, 0), ' ' ORDER BY l.lang) AS docs FROM (SELECT DISTINCT source FROM d) s CROSS JOIN (SELECT DISTINCT lang FROM d) l LEFT JOIN c ON c.source IS NOT DISTINCT FROM s.source AND c.lang = l.lang GROUP BY s.source"""),
    "hierarchy_totals": (hierarchy_totals, _sql("SELECT source, lang, CAST(grouping(source, lang) AS BIGINT) AS level, count(*) AS docs, CAST(sum(num_words) AS BIGINT) AS words FROM s GROUP BY ROLLUP (source, lang)")),
}
