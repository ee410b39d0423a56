"""Columns of text regions: splitting, types, lines left over; merged lines, heights and rendering of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from . import layout as L


def column_features(lines: DataFrame, keys: list[str], col: str = "col", *, text: str = "text") -> DataFrame:
    """Box, number of lines, and what the column types ask of their texts, of each column."""
    long_word = F.exists(F.split(F.trim(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1)
    return lines.groupBy(*keys, col).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"), F.count("*").alias("n_lines"),
        F.coalesce(F.bool_or(long_word), F.lit(False)).alias("has_words"), F.coalesce(F.bool_or(F.length(text) > 3), F.lit(False)).alias("has_long_lines"),
    )


def column_type(page_left: Column, page_right: Column, num_columns: int = 2) -> Column:
    """full_text, extra_text, header_footer, noise_column, or null, from column_features and the page's text width."""
    b = G.Box.of()
    full_width = (page_right - page_left - 300 * (num_columns - 1)) / num_columns
    full = F.when(b.w < full_width - 80, False).when(b.h > 2500, True).when(b.h / F.col("n_lines") > 100, False).otherwise((b.w > 700) & (F.col("n_lines") > 30))
    margin = ~((b.y <= 600) & (b.b > 600)) & ~((b.b >= 3200) & (b.y < 3200)) & (F.col("n_lines") <= 4) & ~((b.w > 500) & (b.h > 150))
    return F.when(full, "full_text").when(F.col("has_words"), "extra_text").when(margin, "header_footer").when(~F.col("has_long_lines"), "noise_column")


def with_column_type(features: DataFrame, keys: list[str], num_columns: int = 2) -> DataFrame:
    w = Window.partitionBy(*keys)
    wide = features.withColumns({"__l": F.min("x").over(w), "__r": F.max("r").over(w)})
    return wide.withColumn("type", column_type(F.col("__l"), F.col("__r"), num_columns)).drop("__l", "__r")


def split_columns(lines: DataFrame, keys: list[str], *, id_col: str = "line_no", min_lines: int = 2, min_gap: int = 20, min_width: int = 20, threshold: float = 0.5) -> DataFrame:
    """`lines` with col (from 1): the column each belongs to, once in each that holds enough of it.

    Columns come from gaps in the lines' coverage; those whose lines' boxes overlap are merged; a line that no column
    holds joins the narrowest that it overlaps with (of equal ones the first) if they share more than half of the
    smaller width, else it has col 0.
    """
    ranges = L.column_ranges(lines, keys, min_lines=min_lines, min_gap=min_gap, min_width=min_width)
    placed = L.lines_in_columns(lines, ranges, keys, threshold)
    inside = placed.where("col is not null")
    boxes = inside.groupBy(*keys, "col").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"))
    sets = L.overlapping_sets(boxes, keys, ["x", "col"]).withColumn("new", F.dense_rank().over(Window.partitionBy(*keys).orderBy("merge_set")))
    merged = sets.groupBy(*keys, "new").agg(*[(F.min if c in "xy" else F.max)(c).alias(f"c_{c}") for c in "xyrb"])
    held = inside.join(sets.select(*keys, "col", "new"), [*keys, "col"]).select(*lines.columns, F.col("new").alias("col")).dropDuplicates([*keys, id_col, "col"])
    left = placed.where("col is null").drop("col")
    a, b = G.Box.of(), G.Box.of("c_")
    near = left.join(merged, keys, "left").withColumn("__s", G.horizontal_overlap(a, b))
    best = Window.partitionBy(*keys, id_col).orderBy((F.coalesce("__s", F.lit(0)) == 0).cast("int"), b.w, "new")
    one = near.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    fits = (F.col("__s") > 0) & G.horizontally_overlapping(a, b)
    return held.unionByName(one.select(*lines.columns, F.when(fits, F.col("new")).otherwise(0).alias("col")))


def average_widths(lines: DataFrame, keys: list[str], *, text: str = "text", width: str = "w") -> DataFrame:
    """Mean width of a character (0 where there are none), of a line in characters and in pixels; lines without text don't count."""
    some = lines.where(F.col(text).isNotNull())
    return some.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(width), F.sum(F.length(text))), F.lit(0.0)).alias("char_width"), F.avg(F.length(text)).alias("line_chars"), F.avg(width).alias("line_width"))


def merge_lines(lines: DataFrame, keys: list[str], order: list[str], *, text: str = "text", remove_break: bool = False, break_char: str = "-") -> DataFrame:
    """One line of all lines of the keys: texts one after another, box around all.

    With `remove_break` a break character goes before a line that begins with a small letter.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    piece = F.col(text)
    if remove_break:
        goes_on = F.lead(text).over(w).rlike(r"^\p{Ll}")
        piece = F.when(piece.endswith(break_char) & F.coalesce(goes_on, F.lit(False)), piece.substr(F.lit(1), F.length(piece) - len(break_char))).otherwise(piece)
    rows = lines.withColumn("__t", piece)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "__t"))), lambda s: s["__t"]), "").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"), F.count("*").alias("n_lines"))


def rendered(rows: DataFrame, keys: list[str], *, text: str = "text", char_width: str = "char_width", direction: str = "ltr") -> DataFrame:
    """`keys`, row and line: the texts of a row's lines (columns row and place of layout.row_groups), gaps between them as spaces."""
    if direction not in ("ltr", "rtl"):
        raise ValueError("direction is ltr or rtl")
    w = Window.partitionBy(*keys, "row").orderBy("place")
    gap = F.col("x") - F.lag("r").over(w)
    spaces = F.when((gap > 0) & (F.col(char_width) > 0), F.repeat(F.lit(" "), F.floor(gap / F.col(char_width)).cast("int"))).otherwise("")
    own = F.coalesce(F.col(text), F.lit(""))
    piece = F.concat(F.coalesce(spaces, F.lit("")), own)
    ordered = F.array_sort(F.collect_list(F.struct("place", "__t")))
    out = rows.withColumn("__t", piece).groupBy(*keys, "row").agg(ordered.alias("p"))
    if direction == "rtl":
        out = out.withColumn("p", F.reverse("p"))
    return out.select(*keys, "row", F.array_join(F.transform("p", lambda s: s["__t"]), "").alias("line"))


def _grid(pts: list[tuple[int, int]], step: int) -> dict[int, int]:
    out = {}
    for p, q in zip(pts, pts[1:]):
        p, q = (q, p) if p[0] > q[0] else (p, q)
        if p[0] == q[0]:
            continue
        slope = (p[1] - q[1]) / (q[0] - p[0])
        for x in range(p[0] + step - p[0] % step, q[0] - q[0] % step + 1, step):
            out[x] = p[1] - int((x - p[0]) * slope)
    return out


def above_and_below(outline: list[tuple[int, int]], baseline: list[tuple[int, int]], step: int = 50) -> tuple[list, list]:
    """An outline's points above the baseline from the left, and the others from the right; none where they don't meet."""
    if not outline or not baseline or max(p[0] for p in outline) < min(p[0] for p in baseline) or min(p[0] for p in outline) > max(p[0] for p in baseline):
        return [], []
    base = list(_grid(baseline, step).items())
    rest = sorted(outline, key=lambda p: p[0])
    above, below, at = [], [], 0
    for k, (x, y) in enumerate(base):
        while at < len(rest):
            p = rest[at]
            if k + 1 < len(base) and abs(base[k + 1][0] - p[0]) < abs(x - p[0]):
                break
            (above if p[1] < y else below).append(p)
            at += 1
    return above, sorted(below, key=lambda p: p[0], reverse=True)


_HEIGHTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("max", "min", "mean", "median")])


def _height_of(o: list[tuple[int, int]], b: list[tuple[int, int]]) -> tuple | None:
    """The heights of one line, point by point."""
    step = 5 if max(p[0] for p in b) - min(p[0] for p in b) <= 50 else 50
    above, _ = above_and_below(o, b, step)
    base, top = _grid(b, step), _grid(above, step)
    h = np.array([base[x] - top[x] for x in base if x in top])
    return (int(h.max()), int(h.min()), int(round(h.mean())), int(np.median(h))) if len(h) else None


def _grids(row: np.ndarray, x: np.ndarray, y: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_grid` of many lines at once: row, x and y of the samples, for points in the order of their rows; `step` has a
    number for each row. Points may not go to the left."""
    a = np.flatnonzero((row[1:] == row[:-1]) & (x[1:] != x[:-1])) if len(row) else np.zeros(0, np.int64)
    px, py, qx, qy, r = x[a], y[a], x[a + 1], y[a + 1], row[a]
    s = step[r]
    start = px + s - px % s
    n = np.maximum((qx - qx % s - start) // s + 1, 0)
    k = np.repeat(np.arange(len(a)), n)
    at = start[k] + (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)) * s[k]
    slope = (py - qy) / (qx - px)
    return r[k], at, py[k] - np.trunc((at - px[k]) * slope[k]).astype(np.int64)


def _heights(rows: int, o: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """(rows, 4) heights, -1 in a fifth column where there are none; o and b: row, x and y of the points of outlines, and
    of baselines that don't go to the left."""
    out = np.zeros((rows, 5), np.int64)
    out[:, 4] = -1
    far = np.iinfo(np.int64).max
    low, high = np.full((2, rows), far), np.full((2, rows), -far)
    for k, (row, x, _) in enumerate((o, b)):
        np.minimum.at(low[k], row, x)
        np.maximum.at(high[k], row, x)
    meets = (high[0] >= low[1]) & (low[0] <= high[1]) & (low[0] < far) & (low[1] < far)
    step = np.where(meets & (high[1] - np.where(low[1] < far, low[1], 0) <= 50), 5, 50)
    o, b = (tuple(c[meets[p[0]]] for c in p) for p in (o, b))
    r, x, y = _grids(*b, step)
    if not len(r):
        return out
    o = tuple(c[np.lexsort((o[1], o[0]))] for c in o)  # from the left, equal ones as they come
    first, many = np.searchsorted(r, np.arange(rows)), np.bincount(r, minlength=rows)
    o = tuple(c[many[o[0]] > 0] for c in o)
    # a point goes with the first sample that no later one is nearer than
    wide = 1 + 2 * (max(int(np.abs(x).max()), int(np.abs(o[1]).max()) if len(o[1]) else 0) + 1) * 2
    middle = np.append(x[:-1] + x[1:], 0)
    last = np.append(r[1:] != r[:-1], True)
    k = np.searchsorted(r * wide + np.where(last, wide // 2, middle), o[0] * wide + 2 * o[1])
    above = o[2] < y[k]
    tr, tx, ty = _grids(*(c[above] for c in o), step)
    if not len(tr):
        return out
    key, own = tr * wide + tx, r * wide + x
    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
    both = key[at] == own
    r, h = r[both], (y - ty[at])[both]
    if not len(r):
        return out
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    n = np.diff(np.append(start, len(r)))
    mean = np.rint(np.add.reduceat(h, start) / n).astype(np.int64)
    middle = np.trunc((h[start + (n - 1) // 2] + h[start + n // 2]) / 2).astype(np.int64)
    out[r[start]] = np.stack([h[start + n - 1], h[start], mean, middle, np.zeros(len(n), np.int64)], axis=1)
    return out


@F.arrow_udf(_HEIGHTS)
def text_heights(outline: pa.Array, baseline: pa.Array) -> pa.Array:
    """Greatest, least, mean (half to even) and median (cut) height of a line's text above its baseline; nulls if unknown."""
    o, b = G.flat_points(outline), G.flat_points(baseline)
    got = _heights(len(outline), o, b)
    back = (b[0][1:] == b[0][:-1]) & (b[1][1:] < b[1][:-1])  # baselines that go to the left, one by one
    for k in np.unique(b[0][1:][back]):
        one = [list(zip(p[1][i:j].tolist(), p[2][i:j].tolist())) for p in (o, b) for i, j in [np.searchsorted(p[0], (k, k + 1))]]
        own = _height_of(*one) if one[0] else None
        got[k] = (*own, 0) if own else (0, 0, 0, 0, -1)
    unknown = got[:, 4] < 0
    return pa.StructArray.from_arrays([pa.array(got[:, i].astype(np.int32), mask=unknown) for i in range(4)], names=["max", "min", "mean", "median"])
