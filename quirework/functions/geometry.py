"""Column expressions over points and boxes. All but the convex hull run in the JVM.

A box is left, top, right and bottom in pixels, right = left + width. Overlaps count both ends, so boxes that touch
overlap by 1. Where a ratio's denominator is 0, the result is null.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    r: Column
    b: Column

    @property
    def w(self) -> Column:
        return self.r - self.x

    @property
    def h(self) -> Column:
        return self.b - self.y

    @property
    def missing(self) -> Column:
        return self.x.isNull() | self.y.isNull() | self.r.isNull() | self.b.isNull()

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The columns x, y, r and b with a prefix."""
        return cls(*(F.col(prefix + c) for c in "xyrb"))

    @classmethod
    def around(cls, points: Column) -> Box:
        """The bounding box of an array of points; nulls for null or none."""
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return cls(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("w"), self.h.alias("h"))

    def corners(self) -> Column:
        """The four corners as points in one string; null without a box."""
        return F.when(~self.missing, F.concat_ws(" ", *[F.concat(x, F.lit(","), y) for x, y in ((self.x, self.y), (self.r, self.y), (self.r, self.b), (self.x, self.b))]))

    def text(self) -> Column:
        """x,y,w,h as one string; null without a box."""
        return F.when(~self.missing, F.concat_ws(",", self.x, self.y, self.w, self.h))


def points(text: Column, strict: bool = False) -> Column:
    """Points of a string "x,y x,y"; parts that aren't two numbers go, or fail if `strict`; null for an empty text."""
    pairs = F.transform(F.split(text, r"\s+"), lambda p: F.split(p, ",", -1))
    number = (lambda c: c.cast("int")) if strict else (lambda c: c.try_cast("int"))
    made = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(number(p[0]).alias("x"), number(p[1]).alias("y")))
    return F.when(F.trim(text) != "", F.filter(made, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))


def point_text(pts: Column) -> Column:
    return F.array_join(F.transform(pts, lambda p: F.concat_ws(",", p["x"], p["y"])), " ")


def box_points(text: Column) -> Column:
    """The four corners of a box given as "x,y,w,h"; null for a null or empty text."""
    n = F.transform(F.split(text, ","), lambda p: p.try_cast("int"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, r, b = n[0], n[1], n[0] + n[2], n[1] + n[3]
    return F.when(F.size(F.split(text, ",", -1)) == 4, F.array(corner(x, y), corner(r, y), corner(r, b), corner(x, b)))


def translate(pts: Column, dx: int, dy: int) -> Column:
    return F.transform(pts, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rescale(pts: Column, factor: float) -> Column:
    """Coordinates times a factor, cut to whole numbers."""
    return F.transform(pts, lambda p: F.struct((p["x"] * factor).cast("int").alias("x"), (p["y"] * factor).cast("int").alias("y")))


# overlaps and distances of two boxes


def _shared(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    # greatest and least pass over nulls; a missing box has no overlap to tell
    return F.when(low1.isNotNull() & high1.isNotNull() & low2.isNotNull() & high2.isNotNull(), F.greatest(F.lit(0), F.least(high1, high2) - F.greatest(low1, low2) + 1))


def horizontal_overlap(a: Box, b: Box, base_a: Box | None = None, base_b: Box | None = None) -> Column:
    """Shared pixels in width; of the baselines if both have one."""
    boxes = _shared(a.x, a.r, b.x, b.r)
    if base_a is None or base_b is None:
        return boxes
    return F.when(~base_a.missing & ~base_b.missing, _shared(base_a.x, base_a.r, base_b.x, base_b.r)).otherwise(boxes)


def vertical_overlap(a: Box, b: Box) -> Column:
    return _shared(a.y, a.b, b.y, b.b)


def _overlapping(shared: Column, low1: Column, high1: Column, low2: Column, high2: Column, threshold: float) -> Column:
    size1, size2 = high1 - low1, high2 - low2
    return (
        F.when((size1 == 0) & (size2 == 0), False)
        .when(size1 == 0, low1.between(low2, high2))
        .when(size2 == 0, low2.between(low1, high1))
        .otherwise(shared / F.least(size1, size2) > threshold)
    )


def horizontally_overlapping(a: Box, b: Box, threshold: float = 0.5) -> Column:
    """Whether more than `threshold` of the narrower width is shared."""
    return _overlapping(horizontal_overlap(a, b), a.x, a.r, b.x, b.r, threshold)


def vertically_overlapping(a: Box, b: Box, threshold: float = 0.5) -> Column:
    return _overlapping(vertical_overlap(a, b), a.y, a.b, b.y, b.b, threshold)


def regions_overlap(a: Box, b: Box, threshold: float = 0.5) -> Column:
    """Whether both shared sides are above `threshold` of one of the boxes; false without a box."""
    h, v = horizontal_overlap(a, b), vertical_overlap(a, b)
    inside = lambda box: (v / (box.h + 1) > threshold) & (h / (box.w + 1) > threshold)
    return F.when(a.missing | b.missing, False).otherwise(inside(a) | inside(b))


def _extent(a: Box, b: Box) -> tuple[Column, Column]:
    return F.greatest(a.r, b.r) - F.least(a.x, b.x), F.greatest(a.b, b.b) - F.least(a.y, b.y)


def horizontal_overlap_ratio(a: Box, b: Box) -> Column:
    return F.try_divide(horizontal_overlap(a, b), _extent(a, b)[0])


def vertical_overlap_ratio(a: Box, b: Box) -> Column:
    return F.try_divide(vertical_overlap(a, b), _extent(a, b)[1])


def horizontal_diff(a: Box, b: Box) -> Column:
    return F.abs(a.x - b.x)


def vertical_diff(a: Box, b: Box) -> Column:
    return F.abs(a.y - b.y)


def horizontal_diff_ratio(a: Box, b: Box) -> Column:
    return F.try_divide(horizontal_diff(a, b), _extent(a, b)[0])


def vertical_diff_ratio(a: Box, b: Box) -> Column:
    return F.try_divide(vertical_diff(a, b), _extent(a, b)[1])


def horizontal_distance(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0), b.x - a.r, a.x - b.r)


def vertical_distance(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0), b.y - a.b, a.y - b.b)


# predicates


def region_type(a: Box) -> Column:
    return F.when((a.w == 0) & (a.h == 0), "POINT").when(a.h == 0, "HLINE").when(a.w == 0, "VLINE").otherwise("BOX")


def inside(x: Column, y: Column, a: Box) -> Column:
    return x.between(a.x, a.r) & y.between(a.y, a.b)


def within_interval(a: Box, start: Column, end: Column, threshold: float = 0.5) -> Column:
    """Whether an interval covers more than `threshold` of a box's width; null for a box without width."""
    return F.try_divide(F.greatest(F.lit(0), F.least(a.r, end) - F.greatest(a.x, start)), a.w) > threshold


def in_same_column(a: Box, b: Box, same_scan: Column, column_a: Column | None = None, column_b: Column | None = None) -> Column:
    """Equal column ids if both have one, else more than half of the first one's width is shared; never across scans."""
    shared = horizontal_overlap(a, b) > a.w / 2
    if column_a is not None and column_b is not None:
        shared = F.when(column_a.isNotNull() & column_b.isNotNull(), column_a == column_b).otherwise(shared)
    return same_scan & shared


def region_below(a: Box, b: Box, margin: int = 20) -> Column:
    return horizontally_overlapping(a, b) & (a.y > b.b - margin)


def region_beside(a: Box, b: Box, margin: int = 20) -> Column:
    return vertically_overlapping(a, b) & (a.x > b.r - margin)


def line_below(a: Box, b: Box, base_a: Box, base_b: Box, majority: Column) -> Column:
    """Whether line a is directly below b: they share width, a's baseline doesn't end above b's, and most of the points
    compared (`majority`) are lower."""
    return (horizontal_overlap(a, b, base_a, base_b) > 0) & (base_a.b >= base_b.y) & majority


def line_beside(a: Box, b: Box, base_a: Box, base_b: Box) -> Column:
    """Whether two lines stand side by side: heights shared, at most 40 pixels of width, baselines at most 10 apart."""
    return (vertical_overlap(a, b) > 0) & (horizontal_overlap(a, b, base_a, base_b) <= 40) & (base_a.y <= base_b.b + 10) & (base_a.b >= base_b.y - 10)


def above_point(a: Box, y: Column | int, first_base: Box | None = None, last_base: Box | None = None) -> Column:
    """True above, false below a height; between, what the first and last line's baselines say, else null."""
    y = F.lit(y) if isinstance(y, int) else y
    out = F.when(a.b < y, True).when(a.y > y, False)
    if first_base is not None and last_base is not None:
        out = out.when(first_base.y > y, False).when(last_base.b < y, True)
    return out


def starts_with_capital(base: Box, pts: Column) -> Column:
    """Whether a baseline is 30 high or more and its first lowest point is within 100 pixels of its left end."""
    lowest = F.filter(pts, lambda p: p["y"] == base.b)[0]
    return (base.h >= 30) & (lowest["x"] - base.x <= 100)


def baseline_heights(base: Box, pts: Column) -> Column:
    """Heights of a baseline's points, without those of a large first letter."""
    ys = F.transform(pts, lambda p: p["y"])
    return F.when(starts_with_capital(base, pts), F.filter(ys, lambda y: y < base.b - 20)).otherwise(ys)


def shape(ratio: Column) -> Column:
    return F.when(ratio < 0.9, "portrait").when(ratio > 1.1, "landscape").otherwise("square")


def derived_id(parent: Column, kind: str, a: Box) -> Column:
    return F.concat_ws("-", parent, F.lit(kind), a.x, a.y, a.w, a.h)


def shoelace(pts: Column) -> Column:
    """Area of a polygon from its points in order."""
    after = F.concat(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    cross = F.zip_with(pts, after, lambda p, q: p["x"].cast("double") * q["y"] - q["x"].cast("double") * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


# baselines


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def sampled(pts: Column, step: int = 50) -> Column:
    """Heights of a baseline at multiples of `step`, as a map from x: (x, y) of each segment, later ones win.

    A segment begins at the next multiple after its left end, also where that end is one.
    """
    pairs = F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda p, q: F.struct(F.when(p["x"] > q["x"], q).otherwise(p).alias("p"), F.when(p["x"] > q["x"], p).otherwise(q).alias("q")))

    def between(pair: Column) -> Column:
        p, q = pair["p"], pair["q"]
        start, end = p["x"] + step - p["x"] % step, q["x"] - q["x"] % step
        slope = (p["y"] - q["y"]) / F.nullif(q["x"] - p["x"], F.lit(0))
        at = F.when((q["x"] != p["x"]) & (start <= end), F.sequence(start, end, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda x: F.struct(x.alias("x"), (p["y"] - ((x - p["x"]) * slope).cast("int")).alias("y")))

    def latest(entries: Column) -> Column:
        once = F.size(F.array_distinct(F.transform(entries, lambda e: e["x"]))) == F.size(entries)  # as for most lines
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["x"] == e["x"]))
        return F.when(once, F.map_from_entries(entries)).otherwise(F.map_from_entries(last))

    return _let(F.flatten(F.transform(pairs, between)), latest)


def average_height(pts: Column) -> Column:
    """Mean height of a baseline weighted by the segments' widths, cut to a whole number."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    areas = F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), lambda p, q: (p["y"] + q["y"]) / 2 * F.abs(q["x"] - p["x"]))
    total = F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)
    width = Box.around(pts).w
    return F.when(width != 0, total / width).otherwise(total).cast("int")


def baseline_distances(a: Column, b: Column, step: int = 50) -> Column:
    """Vertical distances of two baselines where both have a sample, by x; the difference of their mean heights if none."""

    def common(sa: Column, sb: Column) -> Column:
        return F.transform(F.filter(F.map_keys(sa), lambda x: F.map_contains_key(sb, x)), lambda x: F.abs(sb[x] - sa[x]))

    found = _let(sampled(a, step), lambda sa: _let(sampled(b, step), lambda sb: common(sa, sb)))
    return _let(found, lambda d: F.when(F.size(d) > 0, d).otherwise(F.array(F.abs(average_height(a) - average_height(b)))))


def median(values: Column) -> Column:

    def middle(v: Column) -> Column:
        n = F.size(v)
        return F.when(n > 0, (F.element_at(v, F.floor((n + 1) / 2).cast("int")) + F.element_at(v, F.floor(n / 2 + 1).cast("int"))) / 2)

    return _let(F.array_sort(values.cast("array<double>")), middle)


# convex hull: no built-in operator


def hull_points(pts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, from the leftmost; two points or fewer stay as they are, points on one line give its ends."""
    pts = [(int(x), int(y)) for x, y in pts]
    if len(pts) <= 2:
        return pts
    order = sorted(set(pts))
    if len(order) <= 2:
        return order

    def chain(ps):
        out: list[tuple[int, int]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return lower[:-1] + upper[:-1]


def flat_points(points: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, x and y of the points of an array of lists; none for a null."""
    n = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = points.flatten()
    x, y = (pc.struct_field(flat, i) for i in (0, 1))
    if x.null_count or y.null_count:
        raise ValueError("a point has no x or no y")
    return np.repeat(np.arange(len(n)), n), x.to_numpy().astype(np.int64), y.to_numpy().astype(np.int64)


def hull_chain(row: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the lower hull's corners in each row, from the left; points are distinct and sorted by row, x and y.

    A point that isn't below the line from one neighbour to the other is no corner; such points go until none is left.
    """
    at = np.arange(len(row))
    while True:
        r, px, py = row[at], x[at], y[at]
        inner = np.flatnonzero((r[2:] == r[:-2])) + 1 if len(at) > 2 else np.zeros(0, np.int64)
        a, c = inner - 1, inner + 1
        out = (px[inner] - px[a]) * (py[c] - py[a]) <= (py[inner] - py[a]) * (px[c] - px[a])
        if not out.any():
            return at
        at = np.delete(at, inner[out])


def _sides(row: np.ndarray, x: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the cross products of neighbours in each row."""
    same = row[1:] == row[:-1]
    cross = (x[:-1] * y[1:] - x[1:] * y[:-1])[same]
    out = np.zeros(rows, np.int64)
    np.add.at(out, row[1:][same], cross)
    return out


def hull_areas(points: pa.Array) -> np.ndarray:
    """Areas of the convex hulls of lists of points."""
    row, x, y = flat_points(points)
    if not len(row):
        return np.zeros(len(points))
    if max(np.abs(x).max(), np.abs(y).max()) >= 1 << 24:  # else products and sums are exact
        return np.array([_area(hull_points(zip(x[i:j].tolist(), y[i:j].tolist()))) for i, j in np.searchsorted(row, np.stack([np.arange(len(points)), np.arange(len(points)) + 1], axis=1)).tolist()], float)
    order = np.lexsort((y, x, row))
    row, x, y = row[order], x[order], y[order]
    new = np.append(True, (row[1:] != row[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    row, x, y = row[new], x[new], y[new]
    low = hull_chain(row, x, y)
    high = len(row) - 1 - hull_chain(row[::-1], -x[::-1], -y[::-1])[::-1]  # seen from the other side
    return np.abs(_sides(row[low], x[low], y[low], len(points)) - _sides(row[high], x[high], y[high], len(points))) / 2


def _area(corners: list[tuple[int, int]]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(corners, corners[1:] + corners[:1]))) / 2


@F.arrow_udf(POINTS)
def hull(pts: pa.Array) -> pa.Array:
    """Convex hull of an array of points; null for null."""
    return pa.array([None if p is None else [{"x": x, "y": y} for x, y in hull_points((e["x"], e["y"]) for e in p)] for p in pts.to_pylist()], pts.type)


@F.arrow_udf(T.DoubleType())
def hull_area(pts: pa.Array) -> pa.Array:
    """Area of the convex hull of an array of points; null for null."""
    return pa.array(hull_areas(pts), mask=pts.is_null().to_numpy(zero_copy_only=False))


@F.pandas_udf(T.BooleanType())
def most_points_below(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether most of the points of baseline a, walked along with those of b, are lower."""

    def one(p, q):
        if p is None or q is None or not len(p) or not len(q):
            return None
        p, q = [(e["x"], e["y"]) for e in p], [(e["x"], e["y"]) for e in q]
        i = next(k for k in range(len(p)) if k == len(p) - 1 or p[k + 1][0] >= q[0][0])
        j = next(k for k in range(len(q)) if k == len(q) - 1 or q[k + 1][0] >= p[0][0])
        below = seen = 0
        while i < len(p) and j < len(q):
            below += p[i][1] > q[j][1]
            seen += 1
            if p[i][0] <= q[j][0]:
                i += 1
            else:
                j += 1
        return below / seen > 0.5

    return pd.Series(np.array([one(p, q) for p, q in zip(a, b)], object))
