"""Queries that write the driver's tables as documents and read them back: XML, line files, JSON, custom attributes, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import custom as C
from ..functions import geometry as G
from ..sources import line_files, page_xml
from .frames import DOC_LINES, GEO_LINES, GEO_REGIONS, doc_lines, geo_lines, table


def _xml(spark: SparkSession, sf: str) -> DataFrame:
    """A PAGE XML document for each scan of `geo_lines`; a line's text is its number."""
    box = G.Box.of().corners()
    lines = geo_lines(spark, sf).select(F.col("scan").cast("string").alias("path"), F.col("region").alias("region_id"), F.concat(F.lit("l"), "line_no").alias("line_id"), F.col("line_no").alias("pos"), F.concat(F.lit("line "), "line_no", F.lit(" & <so> on")).alias("text"), box.alias("points"), F.concat("x", F.lit(","), "base", F.lit(" "), "r", F.lit(","), "base").alias("baseline"), "x", "y", "r", "b")
    return page_xml.to_xml(lines, ["path"])


def _scans(spark: SparkSession, sf: str, **fields: list[str]) -> DataFrame:
    return page_xml.parse(_xml(spark, sf), fields=fields)


def xml_parse_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = page_xml.lines(_scans(spark, sf, lines=["region_id", "line_id", "text", "points", "baseline"]))
    box = G.Box.around(G.points(F.col("points")))
    return lines.select(F.col("path").cast("long").alias("scan"), F.col("region_id").alias("region"), "line_id", "text", box.text().alias("box"), "baseline")


def xml_region_stats(spark: SparkSession, sf: str) -> DataFrame:
    regions = page_xml.regions(_scans(spark, sf, regions=["region_id", "rank", "n_lines", "points"]))
    return regions.select(F.col("path").cast("long").alias("scan"), F.col("region_id").alias("region"), "rank", "n_lines", G.Box.around(G.points(F.col("points"))).text().alias("box"))


def xml_document_stats(spark: SparkSession, sf: str) -> DataFrame:
    return page_xml.stats(_scans(spark, sf, regions=["kind"], lines=["text", "words"], cells=["cell_id"])).withColumn("path", F.col("path").cast("long"))


def xml_words(spark: SparkSession, sf: str) -> DataFrame:
    return page_xml.words(_scans(spark, sf, lines=["region_id", "line_id", "text", "words"])).groupBy("word").agg(F.count("*").alias("n"))


def _custom(spark: SparkSession, sf: str) -> DataFrame:
    """Each line of documents with a tag for its first word and one for its place."""
    lines = doc_lines(spark, sf).withColumn("n", F.length(F.substring_index("text", " ", 1)))
    text = F.concat(F.lit("readingOrder {index:"), "line_no", F.lit(";} word {offset:0; length:"), "n", F.lit("; kind:first;} unclear {offset: 2;  length :3 ;}"))
    return lines.withColumn("tags", C.custom_tags(text))


def custom_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _custom(spark, sf).select("doc_id", "line_no", F.posexplode("tags").alias("pos", "t")).select("doc_id", "line_no", "pos", "t.tag_name", "t.offset", "t.length", "t.index", F.col("t.attrs")["kind"].alias("kind"))


def inline_tag_text(spark: SparkSession, sf: str) -> DataFrame:
    tag = C.tags_named(F.col("tags"), "word")[0]
    return _custom(spark, sf).select("doc_id", "line_no", C.tagged_text(F.col("text"), tag).alias("word"))


def table_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tables with all their cells: a row for each return flag, as many columns as the largest line number of
    the table says, their values as one text; absent cells are empty."""
    cells = geo_lines(spark, sf).select(F.col("scan").alias("path"), F.lit("t").alias("table_id"), F.ascii("region").alias("row"), (F.col("line_no") - 1).alias("col"), F.concat("x", F.lit("-"), "y").alias("value"))
    n = (cells.agg(F.max("col")).first()[0] or 0) + 1
    return page_xml.table_grid(cells, n).select("path", "table_id", "row", F.lit(n).alias("columns"), F.concat_ws(";", *[f"c{i}" for i in range(n)]).alias("cells"))


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Regions with their lines as JSON and back."""
    lines = geo_lines(spark, sf).groupBy("scan", "region").agg(F.array_sort(F.collect_list(F.struct("line_no", "x", "y", "w", "h"))).alias("lines"))
    docs = lines.groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("region", "lines"))).alias("regions"))
    back = line_files.from_json(line_files.to_json(docs, "scan"), "scan", docs.drop("scan").schema)
    r = back.select("scan", F.explode("regions").alias("r")).select("scan", "r.region", F.explode("r.lines").alias("l"))
    return r.select("scan", "region", "l.line_no", "l.x", "l.y", "l.w", "l.h")


def line_format(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the line format with the line's box."""
    lines = geo_lines(spark, sf).withColumns({"id": F.concat(F.lit("l"), "line_no"), "text": F.concat(F.lit("line "), "line_no")})
    return line_files.line_format(lines, "scan", "region", line="id", boxes={"line_box": G.Box.of()})


def number_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.number_parts(F.concat("source", F.lit(".12A"), "doc_id")), "|").alias("parts"))


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of JSON objects by their keys."""
    e = table(spark, sf, "events")
    return e.select("event_type", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("fields")).groupBy("event_type", "fields").agg(F.count("*").alias("n"))


_TEXT = "'line ' || line_no || ' & <so> on'"
_RULE = "row_number() OVER (PARTITION BY scan ORDER BY region)"
QUERIES = {
    "xml_parse_lines": (xml_parse_lines, f"WITH {GEO_LINES} SELECT scan, region, 'l' || line_no AS line_id, {_TEXT} AS text, format('{{}},{{}},{{}},{{}}', x, y, w, h) AS box, format('{{}},{{}} {{}},{{}}', x, base, r, base) AS baseline FROM geo_lines"),
    "xml_region_stats": (xml_region_stats, f"WITH {GEO_REGIONS} SELECT scan, region, CAST({_RULE} AS INTEGER) AS rank, CAST(n_lines AS INTEGER) AS n_lines, format('{{}},{{}},{{}},{{}}', x, y, w, h) AS box FROM geo_regions"),
    "xml_document_stats": (xml_document_stats, f"WITH {GEO_LINES} SELECT scan AS path, CAST(count(DISTINCT region) AS INTEGER) AS text_regions, 0 AS table_regions, CAST(count(*) AS INTEGER) AS lines, CAST(5 * count(*) AS INTEGER) AS words, CAST(sum(length({_TEXT})) AS INTEGER) AS chars, 0 AS cells FROM geo_lines GROUP BY scan"),
    "xml_words": (xml_words, f"WITH {GEO_LINES}, w AS (SELECT unnest(string_split({_TEXT}, ' ')) AS word FROM geo_lines) SELECT word, count(*) AS n FROM w GROUP BY word"),
    "custom_tags": (custom_tags, f"WITH {DOC_LINES}, n AS (SELECT doc_id, line_no, CAST(length(string_split(text, ' ')[1]) AS INTEGER) AS n FROM doc_lines) SELECT doc_id, line_no, 0 AS pos, 'readingOrder' AS tag_name, CAST(NULL AS INTEGER) AS \"offset\", CAST(NULL AS INTEGER) AS length, line_no AS index, CAST(NULL AS VARCHAR) AS kind FROM n UNION ALL SELECT doc_id, line_no, 1, 'word', 0, n, NULL, 'first' FROM n UNION ALL SELECT doc_id, line_no, 2, 'unclear', 2, 3, NULL, NULL FROM n"),
    "inline_tag_text": (inline_tag_text, f"WITH {DOC_LINES} SELECT doc_id, line_no, string_split(text, ' ')[1] AS word FROM doc_lines"),
    "table_pivot": (table_pivot, f"""WITH {GEO_LINES}, c AS (SELECT scan, region, list({{'i': line_no, 'v': x || '-' || y}}) AS c FROM geo_lines GROUP BY scan, region), m AS (SELECT CAST(max(line_no) AS INTEGER) AS n FROM geo_lines)
SELECT scan AS path, 't' AS table_id, CAST(ascii(region) AS INTEGER) AS row, n AS columns, array_to_string(list_transform(range(1, n + 1), lambda i: coalesce(list_filter(c, lambda e: e.i = i)[1].v, '')), ';') AS cells FROM c, m"""),
    "json_roundtrip": (json_roundtrip, f"WITH {GEO_LINES} SELECT scan, region, line_no, x, y, w, h FROM geo_lines"),
    "line_format": (line_format, f"WITH {GEO_LINES} SELECT CAST(scan AS VARCHAR) AS doc_id, region AS textregion_id, 'l' || line_no AS line_id, 'line ' || line_no AS text, format('{{}},{{}},{{}},{{}}', x, y, w, h) AS line_box FROM geo_lines"),
    "number_parts": (number_parts, r"SELECT doc_id, array_to_string(regexp_extract_all(source || '.12A' || doc_id, '\d+|[A-Za-z]|\.'), '|') AS parts FROM documents"),
    "event_props": (event_props, "SELECT event_type, array_to_string(list_sort(json_keys(props)), ',') AS fields, count(*) AS n FROM events GROUP BY ALL"),
}
