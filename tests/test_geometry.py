import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.functions import geometry as G
from quirework.operators import layout as L


def test_points_and_boxes(spark):
    df = spark.createDataFrame([("0,0 1,1 2,2",), ("3,4 bad 5,6,7 9,x 10,12",), ("",), (None,)], "t string")
    p = G.points(F.col("t"))
    got = df.select(G.point_text(p).alias("p"), G.Box.around(p).text().alias("b")).collect()
    assert [tuple(r) for r in got] == [("0,0 1,1 2,2", "0,0,2,2"), ("3,4 10,12", "3,4,7,8"), (None, None), (None, None)]
    with pytest.raises(Exception, match="invalid points|CAST_INVALID"):
        spark.createDataFrame([("a,b",)], "t string").select(G.points(F.col("t"), strict=True)).collect()
    corners = spark.createDataFrame([("5,15,10,20",), ("",), (None,)], "t string").select(G.point_text(G.box_points(F.col("t"))).alias("p"))
    assert [r.p for r in corners.collect()] == ["5,15 15,15 15,35 5,35", None, None]


CASES = [
    ((1, 1, 1, 1), (1, 1, 1, 1), True), ((1, 1, 1, 1), (1, 2, 1, 2), False), ((1, 1, 1, 1), (0, 1, 5, 1), True), ((1, 1, 1, 1), (1, 0, 1, 5), True),
    ((6, 2, 6, 2), (0, 1, 5, 1), False), ((2, 7, 2, 7), (1, 0, 1, 5), False), ((2, 2, 2, 2), (0, 0, 5, 5), True), ((7, 7, 7, 7), (0, 0, 5, 5), False),
    ((1, 2, 4, 2), (0, 0, 5, 5), True), ((1, 8, 4, 8), (0, 0, 5, 5), False), (None, (0, 0, 1, 1), False),
]


def test_overlap_of_points_lines_and_boxes(spark):
    rows = [(*(a or (None,) * 4), *(b or (None,) * 4), want) for a, b, want in CASES]
    df = spark.createDataFrame(rows, ", ".join(f"{p}{c} int" for p in ("a_", "b_") for c in "xyrb") + ", want boolean")
    a, b = G.Box.of("a_"), G.Box.of("b_")
    for r in df.select("want", G.regions_overlap(a, b).alias("ab"), G.regions_overlap(b, a).alias("ba")).collect():
        assert r.want == r.ab == r.ba


def test_moves(spark):
    df = spark.createDataFrame([("5,15",)], "t string")
    p = G.points(F.col("t"))
    assert df.select(G.point_text(G.translate(p, 10, 20)), G.point_text(G.rescale(p, 2))).first()[:] == ("15,35", "10,30")


def test_hull_and_area(spark):
    rows = [([(0, 0), (50, 0), (50, 50), (0, 50), (25, 25)],), ([(0, 100), (300, 100), (300, 200), (0, 200), (150, 150)],), ([(0, 0), (0, 5)],), ([(0, 0), (1, 1), (2, 2)],), (None,)]
    df = spark.createDataFrame(rows, "p array<struct<x:int,y:int>>")
    assert [r[0] for r in df.select(G.hull_area(F.col("p"))).collect()] == [2500.0, 30000.0, 0.0, 0.0, None]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=20))
def test_hull_holds_all_points(pts):
    hull = G.hull_points(pts)
    n = len(hull)
    if n > 2:
        for x, y in pts:
            for i in range(n):
                (ax, ay), (bx, by) = hull[i], hull[(i + 1) % n]
                assert (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0


LINES = [("s", 1, 100, 100, 200, 100), ("s", 2, 300, 100, 400, 100), ("s", 3, 100, 200, 200, 200), ("s", 4, 300, 200, 400, 200)]


def test_columns(spark):
    df = spark.createDataFrame(LINES, "scan string, line_no int, x int, y int, r int, b int")
    ranges = lambda gap, width: L.column_ranges(df, ["scan"], min_gap=gap, min_width=width)
    assert [(r.start, r.end) for r in ranges(50, 50).orderBy("col").collect()] == [(100, 200), (300, 400)]
    assert ranges(150, 50).count() == 1
    assert ranges(50, 150).count() == 0
    assert [tuple(r) for r in L.column_gaps(ranges(50, 50), ["scan"]).collect()] == [("s", 200, 300)]
    cover = L.coverage(df, ["scan"]).where("start <= 100 and end >= 100").first()
    assert cover.lines == 2
    placed = {r.line_no: r.col for r in L.lines_in_columns(df, ranges(50, 50), ["scan"]).collect()}
    assert placed == {1: 1, 2: 2, 3: 1, 4: 2}
    # a range that begins near 0 goes on to the end of the next
    near = spark.createDataFrame([("s", 5, 100), ("s", 5, 100), ("s", 200, 300), ("s", 200, 300)], "scan string, x int, r int")
    assert [(r.start, r.end) for r in L.column_ranges(near, ["scan"]).collect()] == [(5, 300)]


def test_baseline_distances(spark):
    df = spark.createDataFrame([("0,10 100,20 200,10", "0,60 200,60"), ("0,10 20,10", "30,50 60,70"), ("0,0 10,0", "500,100 600,100")], "a string, b string")
    got = df.select(G.baseline_distances(G.points(F.col("a")), G.points(F.col("b"))).alias("d")).collect()
    # sampled at 50, 100, 150 and 200: heights 15, 20, 15 and 10
    assert got[0].d == [45, 40, 45, 50]
    assert got[1].d == [50] and got[2].d == [100]


def test_pages(spark):
    scans = spark.createDataFrame([("s", 0, 0, 1000, 500)], "scan string, x int, y int, r int, b int")
    pages = {r.side: (r.x, r.r) for r in L.split_pages(scans).collect()}
    assert pages == {"even": (0, 500), "odd": (500, 1000)}
    pages = {r.side: (r.x, r.r) for r in L.split_pages(scans, page_overlap=100).collect()}
    assert pages["even"][1] - 100 == pages["odd"][0] + 100


def test_width_boundaries(spark):
    hist = spark.createDataFrame([(0, 10), (50, 100), (100, 20), (150, 5), (200, 80), (250, 90), (300, 10)], "width long, count long")
    assert [tuple(r) for r in L.width_boundaries(hist).collect()] == [(150, 5)]


def test_merge_sets(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "x"), (4, "c")], "set_id int, item string")
    assert {r.set_id: r.merged_id for r in L.merge_sets(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_majority_below(spark):
    df = spark.createDataFrame([("0,100 100,100", "0,50 100,50"), ("0,50 100,50", "0,100 100,100"), (None, "0,0")], "a string, b string")
    assert [r[0] for r in df.select(G.most_points_below(G.points(F.col("a")), G.points(F.col("b")))).collect()] == [True, False, None]
