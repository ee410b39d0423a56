"""Layout of scans: joins of boxes, distances of lines, columns, pages, reading order, histograms.

Joins of boxes carry the scan as an equality key, so that they shuffle by scan and meet few rows in each. A frame of
boxes has the columns scan, x, y, r (right) and b (bottom), beside any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def pairs(a: DataFrame, b: DataFrame, on: str = "scan") -> DataFrame:
    """All pairs of rows with one scan; the columns get the prefixes a_ and b_."""
    left, right = (d.select(on, *[F.col(c).alias(p + c) for c in d.columns if c != on]) for d, p in ((a, "a_"), (b, "b_")))
    return left.join(right, on)


def line_pairs(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each line with the next one (prefix n_) of its keys; the last has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return lines.withColumns({f"n_{c}": F.lead(c).over(w) for c in lines.columns if c not in keys})


def line_distances(lines: DataFrame, keys: list[str], order: list[str], baseline: str = "baseline") -> DataFrame:
    """`keys`, the line's order columns and distances to the next line (an array)."""
    nexts = line_pairs(lines, keys, order).where(f"n_{order[-1]} is not null")
    return nexts.select(*keys, *order, G.baseline_distances(F.col(baseline), F.col(f"n_{baseline}")).alias("distances"))


def median_distances(distances: DataFrame, keys: list[str]) -> DataFrame:
    """macro, the median of the pairs' mean distances, and micro, that of all distances; one shuffle for both."""
    mean = F.aggregate("distances", F.lit(0.0), lambda s, d: s + d) / F.size("distances")
    got = distances.groupBy(*keys).agg(F.collect_list(mean).alias("__m"), F.flatten(F.collect_list("distances")).alias("__d"))  # the lines of a region
    return got.select(*keys, G.median(F.col("__m")).alias("macro"), G.median(F.col("__d")).alias("micro"))


def median_distance(distances: DataFrame, keys: list[str], kind: str = "macro") -> DataFrame:
    """Median of the pairs' mean distances (macro) or of all distances (micro)."""
    if kind not in ("macro", "micro"):
        raise ValueError("kind is macro or micro")
    return median_distances(distances, keys).select(*keys, F.col(kind).alias("avg_line_distance"))


def coverage(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of x pixels (start to end, both inside) and the number of lines over each; without those of none.

    A line adds one at its left and takes it off after its right, so work follows lines, not pixels.
    """
    events = lines.where("x is not null and r is not null").select(*keys, F.explode(F.array(F.struct(F.col("x").alias("px"), F.lit(1).alias("d")), F.struct((F.col("r") + 1).alias("px"), F.lit(-1).alias("d")))).alias("e"))
    sums = events.select(*keys, "e.px", "e.d").groupBy(*keys, "px").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("px")
    out = sums.withColumns({"lines": F.sum("d").over(w), "end": F.lead("px").over(w) - 1})
    return out.where("lines > 0").select(*keys, F.col("px").alias("start"), "end", "lines")


def _islands(stretches: DataFrame, keys: list[str], min_gap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = stretches.withColumn("__new", F.coalesce(F.col("start") - reach >= min_gap, F.lit(False)).cast("int"))
    return marked.withColumn("__i", F.sum("__new").over(w)).groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def _swallow(islands: DataFrame, keys: list[str], min_gap: int, min_width: int) -> DataFrame:
    """Islands in order folded to ranges: one that begins within `min_gap` of the last range's end (0 at first) goes on
    to the end of the next; one narrower than `min_width` is left out."""
    kind = "struct<out:array<struct<start:int,end:int>>,start:int,last:int>"
    got = islands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("i"))
    init = F.expr("named_struct('out', cast(array() as array<struct<start:int,end:int>>), 'start', cast(null as int), 'last', 0)").cast(kind)

    def step(acc: Column, i: Column) -> Column:
        # acc.start: where an island that was too near began
        start = F.coalesce(acc["start"], i["start"])
        near = start - acc["last"] < min_gap
        wide = i["end"] - start >= min_width
        return F.struct(
            F.when(near | ~wide, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(start.alias("start"), i["end"].alias("end"))))).alias("out"),
            F.when(near, start).alias("start"),
            F.when(near | ~wide, acc["last"]).otherwise(i["end"]).alias("last"),
        ).cast(kind)

    # the last island is flushed whether or not it is near
    body, last = F.slice("i", 1, F.size("i") - 1), F.element_at("i", -1)
    acc = F.col("acc")
    start = F.coalesce(acc["start"], last["start"])
    tail = F.when(last["end"] - start >= min_width, F.array(F.struct(start.alias("start"), last["end"].alias("end")))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    folded = got.withColumn("acc", F.aggregate(body, init, step)).select(*keys, F.posexplode(F.concat(acc["out"], tail)).alias("col", "c"))
    return folded.select(*keys, (F.col("col") + 1).alias("col"), "c.start", "c.end")


def column_ranges(lines: DataFrame, keys: list[str], *, min_lines: int = 2, min_gap: int = 20, min_width: int = 20) -> DataFrame:
    """keys, col (from 1), start and end of the stretches under `min_lines` lines or more, gaps below `min_gap` closed."""
    return _swallow(_islands(coverage(lines, keys).where(F.col("lines") >= min_lines), keys, min_gap), keys, min_gap, min_width)


def text_intervals(lines: DataFrame, keys: list[str], gap: int = 50) -> DataFrame:
    """Stretches under any line, gaps below `gap` closed: the simpler of the two column finders."""
    return column_ranges(lines, keys, min_lines=1, min_gap=gap, min_width=0)


def column_gaps(ranges: DataFrame, keys: list[str], min_gap: int = 20) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("col")
    out = ranges.withColumn("next", F.lead("start").over(w)).where(F.col("next") - F.col("end") >= min_gap)
    return out.select(*keys, F.col("end").alias("gap_start"), F.col("next").alias("gap_end"))


def lines_in_columns(lines: DataFrame, ranges: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Each line with the col that holds more than `threshold` of its width; once for each such column, null for none."""
    rng = ranges.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("col"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    on = G.within_interval(G.Box.of(), F.col("__s"), F.col("__e"), threshold)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return lines.join(rng, on, "left").select(*lines.columns, "col")


def overlapping_sets(boxes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds merge_set: neighbours in order that overlap in width by more than half are in one set."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = G.Box(*(F.lag(c).over(w) for c in "xyrb"))
    new = ~F.coalesce(G.horizontally_overlapping(prev, G.Box.of()), F.lit(False))
    return boxes.withColumn("__new", new.cast("int")).withColumn("merge_set", F.sum("__new").over(w)).drop("__new")


def split_pages(scans: DataFrame, *, page_overlap: int = 0, average: bool = True, keys: list[str] = []) -> DataFrame:
    """The even, odd and, where a scan is far wider than the average, extra page of each scan (columns scan, x, y, r, b).

    The average width is over all scans, or over those with the same `keys` (an inventory).
    """
    if average:
        mean = scans.groupBy(*keys).agg(F.avg(F.col("r") - F.col("x")).alias("__avg"))  # a row for each inventory
        scans = scans.join(mean, keys) if keys else scans.crossJoin(F.broadcast(mean))
        ratio = F.try_divide(F.col("r") - F.col("x"), F.col("__avg"))
        width = F.when((ratio < 0.8) | (ratio > 1.25), F.col("__avg")).otherwise(F.col("r") - F.col("x"))
    else:
        width = F.col("r") - F.col("x")
    half = width / 2
    page = lambda side, a, b: F.struct(F.lit(side).alias("side"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    two = F.array(page("even", F.col("x"), half + page_overlap), page("odd", half - page_overlap, width))
    three = F.concat(two, F.array(page("extra", width, F.col("r") - F.col("x"))))
    out = scans.withColumn("__p", F.explode(F.when(F.col("r") - F.col("x") > width, three).otherwise(two)))
    return out.select("scan", *keys, "__p.side", F.col("__p.start").alias("x"), "y", F.col("__p.end").alias("r"), "b")


def regions_on_pages(regions: DataFrame, pages: DataFrame, id_col: str = "region") -> DataFrame:
    """Each region with the side of the page that it shares most width with; null if it fits none."""
    both = pairs(regions, pages)
    a, b = G.Box.of("a_"), G.Box.of("b_")
    share = F.least(a.r, b.r) - F.greatest(a.x, b.x)
    rank = F.when(F.col("b_side") == "even", 0).when(F.col("b_side") == "odd", 1).otherwise(2)
    best = F.max_by(F.col("b_side"), F.struct(F.col("share"), -F.col("rank")))
    fit = both.where(G.horizontally_overlapping(a, b)).select("scan", F.col(f"a_{id_col}").alias(id_col), "b_side", share.alias("share"), rank.alias("rank")).where("share > 0")
    found = fit.groupBy("scan", id_col).agg(best.alias("side"))
    return regions.join(found, ["scan", id_col], "left")


def layout_histograms(elements: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """element, measure, value and count for each named frame and its measures; one shuffle for each frame."""
    out = None
    for name, (df, measures) in elements.items():
        stack = ", ".join(f"'{m}', cast(`{m}` as double)" for m in measures)
        long = df.selectExpr(f"stack({len(measures)}, {stack}) as (measure, value)").where("value is not null")
        got = long.groupBy("measure", "value").agg(F.count("*").alias("count")).select(F.lit(name).alias("element"), "measure", "value", "count")
        out = got if out is None else out.union(got)
    return out


def width_boundaries(histogram: DataFrame, *, bin_size: int = 50, min_ratio: float = 0.25, min_peak_frac: float = 0.0) -> DataFrame:
    """Minima between the peaks of a histogram (width, count) of binned line widths: boundary, freq.

    The histogram has one row for each bin, so it fits one task whatever the number of lines.
    """
    import pandas as pd

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        freq = dict(zip(pdf["width"], pdf["count"]))
        total, highest = sum(freq.values()), max(freq.values())
        peak, low, low_at, before, found = 0, highest + 1, None, 0, []
        for width in range(0, int(max(freq)) + 1, bin_size):
            n = freq.get(width, 0)
            peak = max(peak, n)
            if n < before and n < low:
                low, low_at = n, width
            if n / total > 0.01 and n > before and n > low and (peak - low) / peak > min_ratio:
                if n / total > min_peak_frac:
                    found.append((low_at, low))
                peak, low = 0, highest + 1
            before = n
        return pd.DataFrame(found, columns=["boundary", "freq"]).astype("int64")

    return histogram.select("width", "count").groupBy().applyInPandas(scan, "boundary long, freq long")


def reading_rank(regions: DataFrame, order: DataFrame | None = None, id_col: str = "region") -> DataFrame:
    """Adds rank (from 1): by the scan's explicit order (scan, region, index), else from top to bottom and left to right.

    An order that leaves out one of the scan's regions is void as a whole.
    """
    top = [F.col("y"), F.col("x"), F.col(id_col)]
    if order is None:
        return regions.withColumn("rank", F.row_number().over(Window.partitionBy("scan").orderBy(*top)))
    o = order.select("scan", F.col(id_col), F.col("index").alias("__index"))
    joined = regions.join(o, ["scan", id_col], "left")
    whole = F.bool_and(F.col("__index").isNotNull()).over(Window.partitionBy("scan"))
    first = F.when(F.col("__whole"), F.col("__index"))
    w = Window.partitionBy("scan").orderBy(first.asc_nulls_last(), *top)
    return joined.withColumn("__whole", whole).withColumn("rank", F.row_number().over(w)).drop("__index", "__whole")


def row_groups(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds row (from 1) and place: lines from top to bottom, those beside the one before in its row, then by x.

    A line without text, or without a box, is left out. Baselines are (base_x, base_y, base_r, base_b) boxes if there, else the boxes.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    own = G.Box.of()
    base = G.Box.of("base_") if "base_x" in lines.columns else own
    prev = G.Box(*(F.lag(c).over(w) for c in (own.x, own.y, own.r, own.b)))
    prev_base = G.Box(*(F.lag(c).over(w) for c in (base.x, base.y, base.r, base.b)))
    # boxes of flat baselines: lower is by the height
    below = (G.horizontal_overlap(own, prev, base, prev_base) > 0) & (base.b >= prev_base.y) & (base.y > prev_base.y)
    beside = G.line_beside(own, prev, base, prev_base)
    joins = F.coalesce(~below & beside, F.lit(False))
    rows = lines.withColumn("__new", (~joins).cast("int")).withColumn("row", F.sum("__new").over(w))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("row", "x", *order))
    return rows.withColumn("place", place).drop("__new")


def merge_sets(memberships: DataFrame, min_overlap: int = 1) -> DataFrame:
    """(set_id, merged_id): sets (set_id, item) that share `min_overlap` items or more, directly or by others, get the
    smallest of their ids. Labels are passed on until they stand still; each round is a written table."""
    m = memberships.select("set_id", "item").distinct()
    linked = m.alias("a").join(m.alias("b"), "item").groupBy(F.col("a.set_id").alias("u"), F.col("b.set_id").alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= min_overlap).select("u", "v")
    linked = linked.checkpoint() if linked.sparkSession.sparkContext.getCheckpointDir() else linked
    labels = m.select(F.col("set_id")).distinct().withColumn("merged_id", F.col("set_id"))
    while True:
        new = linked.join(labels, linked.v == labels.set_id).groupBy("u").agg(F.min("merged_id").alias("l"))
        now = labels.join(new, labels.set_id == new.u, "left").select("set_id", F.least("merged_id", F.coalesce("l", "merged_id")).alias("merged_id"), (F.col("l") < F.col("merged_id")).alias("moved"))
        now = now.checkpoint() if now.sparkSession.sparkContext.getCheckpointDir() else now
        labels = now.select("set_id", "merged_id")
        if now.where("moved").isEmpty():
            return labels
