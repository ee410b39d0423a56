import random
import time

import numpy as np
import pyarrow as pa
import pytest

from quirework.functions import geometry as G
from quirework.operators import columns as C
from quirework.operators import search as S
from quirework.plans import catalogue, search_queries
from quirework.sources import page_xml

POINTS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def _points(rnd, n, sort, low=-300):
    xs = [rnd.randint(low, 400) for _ in range(n)]
    return [{"x": x, "y": rnd.randint(-50, 120)} for x in (sorted(xs) if sort else xs)]


def test_text_heights_of_many_lines():
    rnd = random.Random(3)
    outlines = [None if rnd.random() < 0.05 else _points(rnd, rnd.choice([0, 1, 4, 9, 20]), False) for _ in range(2000)]
    bases = [None if rnd.random() < 0.05 else _points(rnd, rnd.choice([0, 1, 2, 3, 6]), rnd.random() < 0.8, -20) for _ in range(2000)]
    pairs = lambda p: [(e["x"], e["y"]) for e in p]
    want = [(C._height_of(pairs(o), pairs(b)) if o and b else None) or (None,) * 4 for o, b in zip(outlines, bases)]
    got = C.text_heights.func(pa.array(outlines, POINTS), pa.array(bases, POINTS)).to_pylist()
    assert [tuple(g.values()) for g in got] == want and sum(w[0] is not None for w in want) > 300
    box = [{"x": 10, "y": 0}, {"x": 900, "y": 0}, {"x": 900, "y": 40}, {"x": 10, "y": 40}]
    outline, base = pa.array([box] * 10_000, POINTS), pa.array([[{"x": 10, "y": 30}, {"x": 900, "y": 30}]] * 10_000, POINTS)
    start = time.thread_time()
    got = C.text_heights.func(outline, base)
    assert time.thread_time() - start < 3  # point by point it takes about 10 s
    assert set(map(str, got.to_pylist())) == {str({"max": 30, "min": 30, "mean": 30, "median": 30})}


def test_hull_areas_of_many_rows():
    rnd = random.Random(4)
    for wide in (6, 500, 1 << 25):
        lists = [None if rnd.random() < 0.05 else [{"x": rnd.randint(-wide, wide), "y": rnd.randint(-wide, wide)} for _ in range(rnd.choice([0, 1, 2, 3, 5, 30]))] for _ in range(1000)]
        got = G.hull_area.func(pa.array(lists, POINTS)).to_pylist()
        want = [None if p is None else G._area(G.hull_points((e["x"], e["y"]) for e in p)) if len(p) > 2 else 0.0 for p in lists]
        assert got == want
    arc = [{"x": x, "y": x * x} for x in range(-2000, 2000)]
    assert np.isclose(G.hull_areas(pa.array([arc], POINTS))[0], G._area(G.hull_points((e["x"], e["y"]) for e in arc)))


def test_nearest_words_by_bitmaps():
    rnd = random.Random(8)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "É", "x", "9", "\U0001f600"]
    words = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 7))) for _ in range(30_000)})
    asked = [rnd.choice(words) for _ in range(150)] + ["zz", "zzthqq"]
    grams = lambda w: frozenset(f"#{w}#"[i] + f"#{w}#"[i + d] for d in (1, 2) for i in range(len(w) + 2 - d))
    row, gram, many = S._gram_ids(pa.array([w.lower() for w in words + asked]), 1)
    edge = np.searchsorted(row, np.arange(len(words), len(words) + len(asked) + 1))
    sets = [grams(w.lower()) for w in words]
    assert np.bincount(row)[: len(words)].tolist() == [len(s) for s in sets]
    start = time.thread_time()
    known = S._Vocabulary(row[: edge[0]], gram[: edge[0]], len(words), many)
    got = [known.nearest(gram[a:b], 10) for a, b in zip(edge, edge[1:])]
    assert time.thread_time() - start < 3
    for k, q in enumerate(asked):
        if k % 5 == 0 or k >= 150:
            g = grams(q.lower())
            score = np.array([len(g & s) / np.sqrt(float(len(g) * len(s))) for s in sets])
            want = np.lexsort((np.arange(len(words)), -score))[:10]
            want = want[score[want] > 0]
            keep = np.lexsort((got[k][0], -got[k][1]))[:10]
            assert got[k][0][keep].tolist() == want.tolist() and got[k][1][keep].tolist() == score[want].tolist()


def test_plain_documents_read_by_patterns():
    line = '<TextLine id="l{0}" custom="c"><Coords points="{0},1 9,1"/><Baseline points="0,5 9,5"/><TextEquiv conf="0.5"><Unicode>a &amp; {0}</Unicode></TextEquiv></TextLine>'
    page = '<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="n"><Metadata><Creator>x</Creator></Metadata><Page imageFilename="f" imageWidth="9">{}</Page></PcGts>'
    bodies = ["", '<TextRegion id="r">' + "".join(map(line.format, range(200))) + "</TextRegion>", '<TextRegion id="r"></TextRegion>', '<TextRegion id="r" type="t">\n<Coords points=""/>' + line.format(3) + "</TextRegion>"]
    bodies += ['<TextRegion id="r" id="s"></TextRegion>', '<TextRegion id="r">' + line.format("z") + "</TextRegion>", '<TextRegion xmlns="u">' + line.format(1) + "</TextRegion>", "<TextRegion>" + line.format("&lt;") + "</TextRegion>", "<TextRegion>" + line.format(1) + "<!-- c --></TextRegion>", "<TextRegion>" + line.format("1") * 2]

    def run(document):
        try:
            return page_xml.parse_document(document)
        except Exception as e:
            return type(e)

    read = page_xml._read_plain
    for body in bodies:
        document = page.format(body)
        got = run(document)
        page_xml._read_plain = lambda *a: None
        try:
            assert got == run(document) == run(document.encode())
        finally:
            page_xml._read_plain = read
    assert page_xml._read_plain(page.format(bodies[1]), None)["lines"][7]["text"] == "a & 7"


def test_only_the_fields_asked_for_are_made(spark):
    good = '<PcGts xmlns="n"><Page><TextRegion id="r"><TextLine id="a" xheight="3"><Coords points="1,2 3,4"/></TextLine></TextRegion></Page></PcGts>'
    files = spark.createDataFrame([("a", good), ("b", good.replace('"3"', '"bad"'))], "path string, content string")
    whole = page_xml.parse(files)
    some = page_xml.parse(files, fields={"lines": ["points", "line_id"]})
    assert some.columns == ["path", "lines", "error"]
    keys = ["path", "error"]
    assert page_xml.lines(some, keys).sort("path").collect() == page_xml.lines(whole, keys).select(*keys, "line_id", "points").sort("path").collect()
    assert some.select(*keys).sort("path").collect() == whole.select(*keys).sort("path").collect()


@pytest.mark.parametrize("name", ["merged_analyses", "position_totals", "typical_line_words", "line_word_break"])
def test_words_of_lines_are_made_once(spark, monkeypatch, name):
    plans = []
    monkeypatch.setattr(search_queries, "materialise", lambda df, _: plans.append(df) or df)
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    for d in plans[:1] or [df]:
        assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
