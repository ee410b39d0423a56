"""Queries over boxes: `lineitem` as text lines of scans (see frames.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout as L
from .frames import GEO_LINES, GEO_REGIONS, geo_lines, geo_regions, table


def _boxes(df: DataFrame, id_col: str) -> DataFrame:
    return df.select("scan", id_col, "x", "y", "r", "b")


def _line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    lines = _boxes(geo_lines(spark, sf), "line_no")
    return L.pairs(lines, lines).where("a_line_no < b_line_no")


_PAIRS = GEO_LINES + """, p AS (SELECT a.scan, a.line_no AS l1, b.line_no AS l2, a.x AS ax, a.y AS ay, a.r AS ar, a.b AS ab, b.x AS bx, b.y AS "by", b.r AS br, b.b AS bb
  FROM geo_lines a JOIN geo_lines b ON a.scan = b.scan AND a.line_no < b.line_no),
 o AS (SELECT *, greatest(0, least(ar, br) - greatest(ax, bx) + 1) AS ho, greatest(0, least(ab, bb) - greatest(ay, "by") + 1) AS vo FROM p)"""


def _ab() -> tuple[G.Box, G.Box]:
    return G.Box.of("a_"), G.Box.of("b_")


def _ids() -> list:
    return [F.col("a_line_no").alias("l1"), F.col("b_line_no").alias("l2")]


def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _ab()
    ho, vo = G.horizontal_overlap(a, b), G.vertical_overlap(a, b)
    return _line_pairs(spark, sf).select("scan", *_ids(), ho.alias("ho"), vo.alias("vo"), F.round(G.horizontal_overlap_ratio(a, b), 6).alias("hr"), F.round(G.vertical_overlap_ratio(a, b), 6).alias("vr")).where("ho > 0 and vo > 0")


def overlapping_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _ab()
    return _line_pairs(spark, sf).select("scan", *_ids(), G.horizontally_overlapping(a, b).alias("h"), G.vertically_overlapping(a, b).alias("v"), G.regions_overlap(a, b).alias("both"))


def pair_distances(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _ab()
    cols = {"hd": G.horizontal_distance(a, b), "vd": G.vertical_distance(a, b), "hdiff": G.horizontal_diff(a, b), "vdiff": G.vertical_diff(a, b)}
    ratios = {"hdr": G.horizontal_diff_ratio(a, b), "vdr": G.vertical_diff_ratio(a, b)}
    return _line_pairs(spark, sf).select("scan", *_ids(), *[c.alias(n) for n, c in (cols | ratios).items()])


def region_relations(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _ab()
    regions = _boxes(geo_regions(spark, sf), "region")
    p = L.pairs(regions, regions).where("a_region <> b_region")
    return p.select("scan", F.col("a_region").alias("r1"), F.col("b_region").alias("r2"), G.region_below(a, b).alias("below"), G.region_beside(a, b).alias("beside"), G.in_same_column(a, b, F.lit(True)).alias("same_column"), G.regions_overlap(a, b, 0.2).alias("overlap"))


_REGION_PAIRS = GEO_REGIONS + """, o AS (SELECT a.scan, a.region AS r1, b.region AS r2, a.x AS ax, a.y AS ay, a.r AS ar, a.b AS ab, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS "by", b.r AS br, b.b AS bb, b.w AS bw, b.h AS bh,
  greatest(0, least(a.r, b.r) - greatest(a.x, b.x) + 1) AS ho, greatest(0, least(a.b, b.b) - greatest(a.y, b.y) + 1) AS vo
  FROM geo_regions a JOIN geo_regions b ON a.scan = b.scan AND a.region <> b.region)"""


def points_in_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions of the scan that the middle of each line lies in."""
    a, b = _ab()
    lines, regions = _boxes(geo_lines(spark, sf), "line_no"), _boxes(geo_regions(spark, sf), "region")
    mid_x, mid_y = F.expr("(a_x + a_r) div 2"), F.expr("(a_y + a_b) div 2")
    return L.pairs(lines, regions).where(G.inside(mid_x, mid_y, b)).select("scan", F.col("a_line_no").alias("line_no"), F.col("b_region").alias("region"))


def region_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of boxes whose sides are set to 0 in turn."""
    own = geo_lines(spark, sf).selectExpr("scan", "line_no", "x", "y", "case when line_no % 2 = 0 then x else r end r", "case when line_no % 3 = 0 then y else b end b")
    return own.select("scan", "line_no", G.region_type(G.Box.of()).alias("type"), G.derived_id(F.concat(F.lit("s"), "scan"), "line", G.Box.of()).alias("id"), G.Box.of().text().alias("box"))


_WIDE = "case when line_no % 2 = 0 then x else r end"
_HIGH = "case when line_no % 3 = 0 then y else b end"


def parsed_points(spark: SparkSession, sf: str) -> DataFrame:
    """Corner points of each line's box as a string, parsed, moved and scaled; boxes around them."""
    text = F.expr("concat_ws(' ', concat(x, ',', y), concat(r, ',', y), 'bad', concat(r, ',', b), concat(x, ',', b))")
    pts = G.points(text)
    moved = G.translate(G.rescale(F.col("pts"), 0.5), 10, -5)
    return geo_lines(spark, sf).select("scan", "line_no", pts.alias("pts")).select("scan", "line_no", G.point_text(F.col("pts")).alias("points"), G.Box.around(F.col("pts")).text().alias("box"), G.point_text(moved).alias("moved"), G.shoelace(F.col("pts")).alias("area"))


_POINTS_SQL = f"""WITH {GEO_LINES} SELECT scan, line_no, format('{{}},{{}} {{}},{{}} {{}},{{}} {{}},{{}}', x, y, r, y, r, b, x, b) AS points, format('{{}},{{}},{{}},{{}}', x, y, w, h) AS box,
  format('{{}},{{}} {{}},{{}} {{}},{{}} {{}},{{}}', x // 2 + 10, y // 2 - 5, r // 2 + 10, y // 2 - 5, r // 2 + 10, b // 2 - 5, x // 2 + 10, b // 2 - 5) AS moved, (w * h)::DOUBLE AS area FROM geo_lines"""


def bbox_union(spark: SparkSession, sf: str) -> DataFrame:
    return geo_regions(spark, sf).select("scan", "region", "n_lines", G.Box.of().text().alias("box"), F.round(F.try_divide("w", F.col("h")), 6).alias("ratio"), G.shape(F.try_divide("w", F.col("h"))).alias("shape"))


def hull_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Area of the convex hull around the lines of each region."""
    corner = F.expr("array(struct(x, y), struct(r as x, y), struct(r as x, b as y), struct(x, b as y))")
    pts = geo_lines(spark, sf).withColumn("p", corner).groupBy("scan", "region").agg(F.flatten(F.collect_list("p")).alias("pts"))
    return pts.select("scan", "region", G.hull_area(F.col("pts")).alias("area"))


def _with_baseline(lines: DataFrame) -> DataFrame:
    """A baseline of three points that sinks by 6 pixels in the middle."""
    return lines.withColumn("baseline", F.expr("array(named_struct('x', x, 'y', base), named_struct('x', x + w div 2, 'y', base + 6), named_struct('x', r, 'y', base))"))


def line_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of each line to the next in its region."""
    d = L.line_distances(_with_baseline(geo_lines(spark, sf)), ["scan", "region"], ["line_no"])
    return d.select("scan", "region", "line_no", F.size("distances").alias("n"), F.round(G.median(F.col("distances")), 6).alias("median"), F.aggregate("distances", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def line_distance_median(spark: SparkSession, sf: str) -> DataFrame:
    d = L.line_distances(_with_baseline(geo_lines(spark, sf)), ["scan", "region"], ["line_no"])
    return L.median_distances(d, ["scan", "region"]).select("scan", "region", F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


# the heights of a baseline at a multiple of 50: a segment begins after its left end, the second segment counts where both have it
_SAMPLE = """CASE WHEN {x} > {l}.x + {l}.w // 2 AND {x} <= {l}.r - {l}.r % 50 THEN {l}.base + 6 - CAST(trunc(({x} - ({l}.x + {l}.w // 2)) * (6.0::DOUBLE / nullif({l}.r - {l}.x - {l}.w // 2, 0))) AS INTEGER)
  WHEN {x} > {l}.x AND {x} <= {l}.x + {l}.w // 2 THEN {l}.base - CAST(trunc(({x} - {l}.x) * (-6.0::DOUBLE / nullif({l}.w // 2, 0))) AS INTEGER) END"""
_DISTANCES = GEO_LINES + f""", nx AS (SELECT *, lead(line_no) OVER (PARTITION BY scan, region ORDER BY line_no) AS n FROM geo_lines),
 pr AS (SELECT a.scan, a.region, a.line_no, {_SAMPLE.format(x='g.px', l='a')} AS ya, {_SAMPLE.format(x='g.px', l='b')} AS yb, a.base AS ba, b.base AS bb
   FROM nx a JOIN nx b ON a.scan = b.scan AND a.region = b.region AND b.line_no = a.n LEFT JOIN (SELECT unnest(range(0, 4000, 50)) AS px) g ON g.px > greatest(a.x, b.x) AND g.px <= least(a.r, b.r)),
 ds AS (SELECT scan, region, line_no, list(abs(yb - ya)) FILTER (WHERE ya IS NOT NULL AND yb IS NOT NULL) AS d, any_value(abs(ba - bb)) AS f FROM pr GROUP BY ALL),
 dist AS (SELECT scan, region, line_no, coalesce(d, [f]) AS d FROM ds)"""


def pixel_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels over each scan by the number of lines above them."""
    return L.coverage(geo_lines(spark, sf), ["scan"]).groupBy("scan", "lines").agg(F.sum(F.col("end") - F.col("start") + 1).alias("pixels"))


_COVERAGE_SQL = f"""WITH {GEO_LINES}, px AS (SELECT scan, unnest(range(x, r + 1)) AS p FROM geo_lines), c AS (SELECT scan, p, count(*) AS lines FROM px GROUP BY scan, p)
SELECT scan, lines, count(*) AS pixels FROM c GROUP BY scan, lines"""


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    return L.column_ranges(_shifted(geo_lines(spark, sf)), ["scan"])


def _shifted(lines: DataFrame) -> DataFrame:
    """Lines whose left end is 30 or more, so that no range begins near 0."""
    return lines.withColumns({"x": F.col("x") + 30, "r": F.col("r") + 30})


# for x >= 20 no interval is swallowed at the start; one below the least width is left out
_RANGES = GEO_LINES + """, px AS (SELECT scan, unnest(range(x + 30, r + 31)) AS p FROM geo_lines), c AS (SELECT scan, p FROM px GROUP BY scan, p HAVING count(*) >= 2),
 g AS (SELECT scan, p, CASE WHEN p - lag(p) OVER (PARTITION BY scan ORDER BY p) >= 20 THEN 1 ELSE 0 END AS n FROM c),
 i AS (SELECT scan, p, sum(n) OVER (PARTITION BY scan ORDER BY p) AS i FROM g),
 rng AS (SELECT scan, CAST(row_number() OVER (PARTITION BY scan ORDER BY s) AS INTEGER) AS col, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM (SELECT scan, min(p) AS s, max(p) AS e FROM i GROUP BY scan, i) WHERE e - s >= 20)"""


def column_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return L.column_gaps(_ranges(spark, sf), ["scan"])


def lines_in_columns(spark: SparkSession, sf: str) -> DataFrame:
    lines = _shifted(geo_lines(spark, sf)).select("scan", "line_no", "x", "y", "r", "b")
    return L.lines_in_columns(lines, _ranges(spark, sf), ["scan"]).select("scan", "line_no", "col")


def merge_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of a scan by left end, neighbours that overlap in one set: the sets' boxes and numbers of lines."""
    sets = L.overlapping_sets(geo_regions(spark, sf), ["scan"], ["x", "region"])
    return sets.groupBy("scan", "merge_set").agg(F.min("x").alias("x"), F.max("r").alias("r"), F.sum("n_lines").alias("n_lines"), F.array_join(F.array_sort(F.collect_set("region")), "+").alias("regions"))


_MERGE_SQL = f"""WITH {GEO_REGIONS}, w AS (SELECT *, lag(x) OVER o AS px, lag(r) OVER o AS pr FROM geo_regions WINDOW o AS (PARTITION BY scan ORDER BY x, region)),
 f AS (SELECT *, CASE WHEN px IS NOT NULL AND greatest(0, least(r, pr) - greatest(x, px) + 1)::DOUBLE / least(r - x, pr - px) > 0.5 THEN 0 ELSE 1 END AS n FROM w),
 s AS (SELECT *, sum(n) OVER (PARTITION BY scan ORDER BY x, region) AS merge_set FROM f)
SELECT scan, CAST(merge_set AS BIGINT) AS merge_set, min(x) AS x, max(r) AS r, CAST(sum(n_lines) AS BIGINT) AS n_lines, string_agg(region, '+' ORDER BY region) AS regions FROM s GROUP BY scan, merge_set"""


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    return geo_lines(spark, sf).groupBy("scan").agg(F.lit(0).alias("x"), F.lit(0).alias("y"), F.max("r").alias("r"), F.max("b").alias("b"))


_SCANS = GEO_REGIONS + ", scans AS (SELECT scan, max(r) AS r, max(b) AS b FROM geo_lines GROUP BY scan)"
_PAGES = _SCANS + """, aw AS (SELECT *, avg(r) OVER () AS av FROM scans), sw AS (SELECT *, CASE WHEN r / av < 0.8 OR r / av > 1.25 THEN av ELSE r::DOUBLE END AS wd FROM aw),
 pages AS (SELECT scan, 'even' AS side, 0 AS x, CAST(floor(wd / 2) AS INTEGER) AS r, b FROM sw UNION ALL SELECT scan, 'odd', CAST(floor(wd / 2) AS INTEGER), CAST(floor(wd) AS INTEGER), b FROM sw
   UNION ALL SELECT scan, 'extra', CAST(floor(wd) AS INTEGER), r, b FROM sw WHERE r > wd)"""


def split_pages(spark: SparkSession, sf: str) -> DataFrame:
    return L.split_pages(_scans(spark, sf)).select("scan", "side", "x", "r", "b")


def regions_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    return L.regions_on_pages(geo_regions(spark, sf), L.split_pages(_scans(spark, sf))).select("scan", "region", "side")


_ON_PAGES_SQL = f"""WITH {_PAGES}, j AS (SELECT g.scan, g.region, p.side, least(g.r, p.r) - greatest(g.x, p.x) AS share, CASE side WHEN 'even' THEN 0 WHEN 'odd' THEN 1 ELSE 2 END AS k
   FROM geo_regions g JOIN pages p USING (scan) WHERE CASE WHEN g.w = 0 AND p.r = p.x THEN false WHEN g.w = 0 THEN g.x BETWEEN p.x AND p.r WHEN p.r = p.x THEN p.x BETWEEN g.x AND g.r
     ELSE greatest(0, least(g.r, p.r) - greatest(g.x, p.x) + 1)::DOUBLE / least(g.w, p.r - p.x) > 0.5 END),
 best AS (SELECT scan, region, arg_max(side, share * 10 - k) AS side FROM j WHERE share > 0 GROUP BY scan, region)
SELECT scan, region, side FROM geo_regions LEFT JOIN best USING (scan, region)"""


def average_scan_size(spark: SparkSession, sf: str) -> DataFrame:
    return _scans(spark, sf).agg(F.count("*").alias("scans"), F.round(F.avg("r"), 6).alias("avg_width"), F.round(F.avg("b"), 6).alias("avg_height"))


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of regions: by name where a scan has an explicit order (even scans; void in every tenth), else by place."""
    regions = geo_regions(spark, sf)
    order = regions.where("scan % 2 = 0 and not (scan % 10 = 0 and region = 'N')").select("scan", "region", F.ascii("region").alias("index"))
    return L.reading_rank(regions, order).select("scan", "region", "rank")


_ORDER_SQL = f"""WITH {GEO_REGIONS}, o AS (SELECT *, CASE WHEN scan % 2 = 0 AND NOT (scan % 10 = 0 AND region = 'N') THEN ascii(region) END AS i FROM geo_regions),
 w AS (SELECT *, bool_and(i IS NOT NULL) OVER (PARTITION BY scan) AS whole FROM o)
SELECT scan, region, CAST(row_number() OVER (PARTITION BY scan ORDER BY CASE WHEN whole THEN i END NULLS LAST, y, x, region) AS INTEGER) AS rank FROM w"""


def row_groups(spark: SparkSession, sf: str) -> DataFrame:
    return L.row_groups(geo_lines(spark, sf), ["scan"], ["y", "line_no"]).select("scan", "line_no", F.col("row").cast("int"), "place")


_ROWS_SQL = f"""WITH {GEO_LINES}, w AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(r) OVER o AS pr, lag(b) OVER o AS pb FROM geo_lines WINDOW o AS (PARTITION BY scan ORDER BY y, line_no)),
 f AS (SELECT *, greatest(0, least(r, pr) - greatest(x, px) + 1) AS ho, greatest(0, least(b, pb) - greatest(y, py) + 1) AS vo FROM w),
 j AS (SELECT *, CASE WHEN px IS NOT NULL AND NOT (ho > 0 AND b >= py AND y > py) AND vo > 0 AND ho <= 40 AND y <= pb + 10 AND b >= py - 10 THEN 0 ELSE 1 END AS n FROM f),
 g AS (SELECT *, sum(n) OVER (PARTITION BY scan ORDER BY y, line_no) AS rw FROM j)
SELECT scan, line_no, CAST(rw AS INTEGER) AS "row", CAST(row_number() OVER (PARTITION BY scan ORDER BY rw, x, y, line_no) AS INTEGER) AS place FROM g"""


def layout_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return L.layout_histograms({"line": (geo_lines(spark, sf), ["h", "w"]), "region": (geo_regions(spark, sf), ["h", "w", "n_lines"])})


_HISTOGRAM_SQL = f"""WITH {GEO_REGIONS} SELECT 'line' AS element, m AS measure, v::DOUBLE AS value, count(*) AS count FROM (SELECT unnest(['h', 'w']) AS m, unnest([h, w]) AS v FROM geo_lines) GROUP BY m, v
UNION ALL SELECT 'region', m, v::DOUBLE, count(*) FROM (SELECT unnest(['h', 'w', 'n_lines']) AS m, unnest([h, w, n_lines]) AS v FROM geo_regions) GROUP BY m, v"""


def width_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return geo_lines(spark, sf).groupBy((F.floor(F.col("w") / 50) * 50).alias("width")).agg(F.count("*").alias("count"))


def width_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return L.width_boundaries(width_histogram(spark, sf))


def main_text_width(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the binned widths of lines in regions with more than 2 lines, less and plus a standard deviation."""
    big = geo_regions(spark, sf).where("n_lines > 2").select("scan", "region")
    width = F.floor(F.col("w") / 50) * 50
    lines = geo_lines(spark, sf).join(big, ["scan", "region"], "left_semi").select(width.alias("v"))
    return lines.agg(F.round(F.avg("v") - F.stddev_pop("v"), 4).alias("least"), F.round(F.avg("v") + F.stddev_pop("v"), 4).alias("most"))


def main_text_range(spark: SparkSession, sf: str) -> DataFrame:
    """Mean left and right ends of lines by page side, and mean top and bottom of regions relative to their scan."""
    pages = L.split_pages(_scans(spark, sf))
    sides = L.regions_on_pages(geo_regions(spark, sf), pages).select("scan", "region", "side")
    ends = geo_lines(spark, sf).join(sides, ["scan", "region"]).where("side is not null").groupBy("side").agg(F.floor(F.avg("x")).alias("left"), F.floor(F.avg("r")).alias("right"))
    scans = _scans(spark, sf).select("scan", F.col("b").alias("sb"))
    rel = geo_regions(spark, sf).join(scans, "scan").groupBy("scan").agg(F.min(F.col("y") / F.col("sb")).alias("t"), F.max(F.col("b") / F.col("sb")).alias("e"))
    top = rel.agg(F.greatest(F.lit(0.0), F.avg("t") - F.stddev_pop("t")).alias("top"), F.least(F.lit(1.0), F.avg("e") + F.stddev_pop("e")).alias("bottom"))
    return ends.crossJoin(top).select("side", "left", "right", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


_MAIN_SQL = f"""WITH s AS ({_ON_PAGES_SQL}), {_SCANS},
 e AS (SELECT side, CAST(floor(avg(x)) AS BIGINT) AS "left", CAST(floor(avg(r)) AS BIGINT) AS "right" FROM geo_lines JOIN s USING (scan, region) WHERE side IS NOT NULL GROUP BY side),
 rel AS (SELECT g.scan, min(g.y / s.b) AS t, max(g.b / s.b) AS e FROM geo_regions g JOIN scans s USING (scan) GROUP BY g.scan),
 tb AS (SELECT greatest(0.0::DOUBLE, avg(t) - stddev_pop(t)) AS top, least(1.0::DOUBLE, avg(e) + stddev_pop(e)) AS bottom FROM rel)
SELECT side, "left", "right", round(top, 6) AS top, round(bottom, 6) AS bottom FROM e, tb"""

_OV = lambda shared, s1, s2, a1, b1, a2, b2: f"CASE WHEN {s1} = 0 AND {s2} = 0 THEN false WHEN {s1} = 0 THEN {a1} BETWEEN {a2} AND {b2} WHEN {s2} = 0 THEN {a2} BETWEEN {a1} AND {b1} ELSE {shared}::DOUBLE / least({s1}, {s2}) > 0.5 END"
_H = _OV("ho", "(ar - ax)", "(br - bx)", "ax", "ar", "bx", "br")
_V = _OV("vo", "(ab - ay)", '(bb - "by")', "ay", "ab", '"by"', "bb")


def _both(threshold: float) -> str:
    side = lambda w, h: f"(vo::DOUBLE / ({h} + 1) > {threshold} AND ho::DOUBLE / ({w} + 1) > {threshold})"
    return side("(ar - ax)", "(ab - ay)") + " OR " + side("(br - bx)", '(bb - "by")')


QUERIES = {
    "overlap_pairs": (overlap_pairs, f'WITH {_PAIRS} SELECT scan, l1, l2, ho, vo, round(ho::DOUBLE / (greatest(ar, br) - least(ax, bx)), 6) AS hr, round(vo::DOUBLE / (greatest(ab, bb) - least(ay, "by")), 6) AS vr FROM o WHERE ho > 0 AND vo > 0'),
    "overlapping_pairs": (overlapping_pairs, f'WITH {_PAIRS} SELECT scan, l1, l2, {_H} AS h, {_V} AS v, ({_both(0.5)}) AS "both" FROM o'),
    "pair_distances": (pair_distances, f'WITH {_PAIRS} SELECT scan, l1, l2, greatest(0, bx - ar, ax - br) AS hd, greatest(0, "by" - ab, ay - bb) AS vd, abs(ax - bx) AS hdiff, abs(ay - "by") AS vdiff, abs(ax - bx)::DOUBLE / (greatest(ar, br) - least(ax, bx)) AS hdr, abs(ay - "by")::DOUBLE / (greatest(ab, bb) - least(ay, "by")) AS vdr FROM o'),
    "region_relations": (region_relations, f'WITH {_REGION_PAIRS} SELECT scan, r1, r2, ({_H}) AND ay > bb - 20 AS below, ({_V}) AND ax > br - 20 AS beside, ho > aw / 2 AS same_column, ({_both(0.2)}) AS overlap FROM o'),
    "points_in_regions": (points_in_regions, f"WITH {GEO_REGIONS} SELECT l.scan, l.line_no, g.region FROM geo_lines l JOIN geo_regions g ON l.scan = g.scan AND (l.x + l.r) // 2 BETWEEN g.x AND g.r AND (l.y + l.b) // 2 BETWEEN g.y AND g.b"),
    "region_types": (region_types, f"WITH {GEO_LINES}, z AS (SELECT scan, line_no, x, y, {_WIDE} - x AS w, {_HIGH} - y AS h FROM geo_lines) SELECT scan, line_no, CASE WHEN w = 0 AND h = 0 THEN 'POINT' WHEN h = 0 THEN 'HLINE' WHEN w = 0 THEN 'VLINE' ELSE 'BOX' END AS type, format('s{{}}-line-{{}}-{{}}-{{}}-{{}}', scan, x, y, w, h) AS id, format('{{}},{{}},{{}},{{}}', x, y, w, h) AS box FROM z"),
    "parsed_points": (parsed_points, _POINTS_SQL),
    "bbox_union": (bbox_union, f"WITH {GEO_REGIONS} SELECT scan, region, n_lines, format('{{}},{{}},{{}},{{}}', x, y, w, h) AS box, round(w::DOUBLE / h, 6) AS ratio, CASE WHEN w::DOUBLE / h < 0.9 THEN 'portrait' WHEN w::DOUBLE / h > 1.1 THEN 'landscape' ELSE 'square' END AS shape FROM geo_regions"),
    "hull_areas": (hull_areas, None),
    "line_gaps": (line_gaps, f"WITH {_DISTANCES} SELECT scan, region, line_no, CAST(len(d) AS INTEGER) AS n, round(list_median(d), 6) AS median, CAST(list_sum(d) AS BIGINT) AS total FROM dist"),
    "line_distance_median": (line_distance_median, f"WITH {_DISTANCES}, mi AS (SELECT scan, region, unnest(d) AS v FROM dist) SELECT scan, region, round(quantile_cont(list_avg(d), 0.5), 6) AS macro, any_value(micro) AS micro FROM dist JOIN (SELECT scan, region, round(quantile_cont(v, 0.5), 6) AS micro FROM mi GROUP BY scan, region) USING (scan, region) GROUP BY scan, region"),
    "pixel_coverage": (pixel_coverage, _COVERAGE_SQL),
    "column_ranges": (_ranges, f"WITH {_RANGES} SELECT * FROM rng"),
    "column_gaps": (column_gaps, f'WITH {_RANGES}, n AS (SELECT *, lead(start) OVER (PARTITION BY scan ORDER BY col) AS nx FROM rng) SELECT scan, "end" AS gap_start, nx AS gap_end FROM n WHERE nx - "end" >= 20'),
    "lines_in_columns": (lines_in_columns, f'WITH {_RANGES} SELECT l.scan, l.line_no, g.col FROM geo_lines l LEFT JOIN rng g ON l.scan = g.scan AND greatest(0, least(l.r + 30, g."end") - greatest(l.x + 30, g.start))::DOUBLE / l.w > 0.5'),
    "merge_columns": (merge_columns, _MERGE_SQL),
    "split_pages": (split_pages, f"WITH {_PAGES} SELECT scan, side, x, r, b FROM pages"),
    "regions_on_pages": (regions_on_pages, _ON_PAGES_SQL),
    "average_scan_size": (average_scan_size, f"WITH {_SCANS} SELECT count(*) AS scans, round(avg(r), 6) AS avg_width, round(avg(b), 6) AS avg_height FROM scans"),
    "reading_order": (reading_order, _ORDER_SQL),
    "row_groups": (row_groups, _ROWS_SQL),
    "layout_histograms": (layout_histograms, _HISTOGRAM_SQL),
    "width_histogram": (width_histogram, f"WITH {GEO_LINES} SELECT CAST(w // 50 * 50 AS BIGINT) AS width, count(*) AS count FROM geo_lines GROUP BY 1"),
    "width_boundaries": (width_boundaries, None),
    "main_text_width": (main_text_width, f"WITH {GEO_REGIONS}, l AS (SELECT w // 50 * 50 AS v FROM geo_lines SEMI JOIN (SELECT scan, region FROM geo_regions WHERE n_lines > 2) USING (scan, region)) SELECT round(avg(v) - stddev_pop(v), 4) AS least, round(avg(v) + stddev_pop(v), 4) AS most FROM l"),
    "main_text_range": (main_text_range, _MAIN_SQL),
}
