from quirework.plans import catalogue
from quirework.plans.frames import geo_lines

Q = catalogue.queries()
SF = "/root/testdata/sf0.001"


def test_pivot_has_every_cell(spark):
    lines = geo_lines(spark, SF).collect()
    most = max(r.line_no for r in lines)
    assert most > 3
    want = {}
    for r in lines:
        want.setdefault((r.scan, ord(r.region)), [""] * most)[r.line_no - 1] = f"{r.x}-{r.y}"
    out = Q["table_pivot"](spark, SF).collect()
    assert len(out) == len(want) and {(r.path, r.row): r.cells.split(";") for r in out} == want
