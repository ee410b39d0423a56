import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quirework.functions import custom as C
from quirework.functions import text as T
from quirework.operators import running_text as R
from quirework.operators import tokens as K
from quirework.sources import archives, line_files, page_xml

XML = """<?xml version="1.0"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Metadata><Creator>me</Creator><Created>2018-07-19T10:33:16</Created></Metadata>
<Page imageFilename="a.jpg" imageWidth="100" imageHeight="50"><ReadingOrder><OrderedGroup id="ro" caption="c"><RegionRefIndexed index="0" regionRef="r2"/><RegionRefIndexed index="1" regionRef="r1"/><RegionRefIndexed index="2" regionRef="t1"/></OrderedGroup></ReadingOrder>
<TextRegion id="r1" custom="structure {type:marginalia;}"><Coords points="0,0 10,0 10,10"/><TextRegion id="r1a"><TextLine id="l0"><Coords points="1,1 5,1 5,4"/><TextEquiv conf="0.5"><Unicode>inner &amp; line</Unicode></TextEquiv></TextLine></TextRegion>
<TextLine id="l1"><Coords points="1,5 9,5 9,9"/><Baseline points="1,8 9,8"/><Word id="w"><TextEquiv><Unicode>own</Unicode></TextEquiv></Word><Word id="v"/><TextEquiv><Unicode>own line</Unicode></TextEquiv></TextLine></TextRegion>
<TextRegion id="r2"><Coords points="20,0 30,0 30,10"/></TextRegion><TextRegion id="void"/>
<TableRegion id="t1"><Coords points="0,20 50,20 50,40"/><TableCell id="c1" row="0" col="0"><Coords points="0,20 5,25"/><CornerPts>0 1 2 3</CornerPts><TextLine id="l2"><TextEquiv><Unicode>3-8</Unicode></TextEquiv></TextLine></TableCell><TableCell id="c2" row="1" col="1"/></TableRegion>
</Page></PcGts>"""


def test_xml(spark):
    files = spark.createDataFrame([("a", XML), ("bad", "<x>"), ("no", "<PcGts/>"), ("null", None)], "path string, content string")
    scans = page_xml.parse(files).cache()
    row = {r.path: r for r in scans.collect()}
    a = row["a"]
    assert (a.filename, a.width, a.reading_order, a.ro_caption, a.error) == ("a.jpg", 100, {0: "r2", 1: "r1", 2: "t1"}, "c", None)
    assert all(row[p].error for p in ("bad", "no", "null"))
    regions = {r.region_id: r for r in page_xml.regions(scans).collect()}
    assert {k: (r.parent_id, r.region_path, r.rank, r.n_lines) for k, r in regions.items()} == {"r1": (None, [0], 2, 1), "r1a": ("r1", [0, 0], None, 1), "r2": (None, [1], 1, 0), "t1": (None, [3], 3, 1)}
    assert regions["r1a"].points == "1,1 5,1 5,4"
    lines = page_xml.lines(scans).orderBy("pos").collect()
    assert [(r.line_id, r.region_id, r.text, r.conf) for r in lines] == [("l0", "r1a", "inner & line", 0.5), ("l1", "r1", "own line", None), ("l2", "t1", "3-8", None)]
    assert [(r.line_id, r.word) for r in page_xml.words(scans).where("line_id <> 'l2'").orderBy("line_id", "word_pos").collect()] == [("l0", "inner"), ("l0", "&"), ("l0", "line"), ("l1", "own")]
    assert page_xml.table_grid(page_xml.cells(scans), 2).orderBy("row").select("c0", "c1").collect() == [("3-8", ""), ("", "")]
    assert page_xml.stats(scans).where("path = 'a'").first()[1:] == (3, 1, 3, 5, 23, 2)
    with pytest.raises(Exception, match="there is no Page"):
        page_xml.parse(files.where("path = 'no'"), mode="failfast").collect()
    again = page_xml.parse_document(page_xml.document_xml(page_xml.parse_document(XML)))
    first = page_xml.parse_document(XML)
    drop = lambda d: {**d, "namespace": None, "regions": [{**r, "attrs": None, "path": None} for r in d["regions"]], "lines": [{**x, "attrs": None} for x in d["lines"]]}
    assert drop(again) == drop(first)
    assert page_xml.violations(XML) == []
    assert page_xml.violations(XML.replace("<Baseline points=\"1,8 9,8\"/>", "<Baseline/><Baseline/><Page/>")) == ["a second Baseline in TextLine", "Page in TextLine"]


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/x.xml", XML)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.xml", XML)
        z.writestr("sub/inner.zip", inner.getvalue())
        z.writestr("readme.txt", "no document")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d\\y.xml")
        info.size = len(XML.encode())
        t.addfile(info, io.BytesIO(XML.encode()))
    got = archives.read(spark, str(tmp_path))
    rows = sorted((r.archived_filepath, r.archived_filename, [s.rpartition("/")[2] for s in r.source_file], len(r.content)) for r in got.collect())
    n = len(XML.encode())
    assert rows == [("d\\y.xml", "y.xml", ["b.tar.gz"], n), ("deep/x.xml", "x.xml", ["a.zip", "inner.zip"], n), ("one.xml", "one.xml", ["a.zip"], n), ("readme.txt", "readme.txt", ["a.zip"], 11)]
    assert all(r.content is None for r in archives.read(spark, str(tmp_path), names_only=True).collect())
    assert archives.parse(spark, str(tmp_path)).where("error is null").count() == 3


def test_line_files(spark, tmp_path):
    rows = [("d", "r1", "l1", "tab\there"), ("d", "r1", "l2", ""), ("d", "r2", "l3", None), ("e", "r", "l", "back\\slash\nand line")]
    df = spark.createDataFrame(rows, ", ".join(f"{h} string" for h in line_files.HEADERS))
    line_files.write_lines(df, str(tmp_path / "lines"))
    back = line_files.read_lines(spark, str(tmp_path / "lines"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    docs = {r.doc_id: [(g.textregion_id, [x.line_id for x in g.lines]) for g in r.regions] for r in line_files.documents(back, ["line_id"]).collect()}
    assert docs == {"d": [("r1", ["l1", "l2"]), ("r2", ["l3"])], "e": [("r", ["l"])]}
    with pytest.raises(Exception, match="too many fields"):
        line_files.read_lines(spark, str(tmp_path / "lines"), ["doc_id"]).collect()


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(XML)
    stream = page_xml.lines(page_xml.read_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("xml_lines").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("xml_lines").count() == 3


def test_custom_tags(spark):
    s = "readingOrder {index:0;} unclear {offset: 9;  length :5 ;} textStyle {offset:13; length:1;superscript:true;} textStyle {offset:20; length:1;}"
    tags = spark.createDataFrame([(s,)], "c string").select(C.custom_tags(F.col("c")).alias("t")).first().t
    assert [(t.tag_name, t.offset, t.length, t["index"]) for t in tags] == [("readingOrder", None, None, 0), ("unclear", 9, 5, None), ("textStyle", 13, 1, None), ("textStyle", 20, 1, None)]
    assert tags[2].attrs["superscript"] == "true"
    times = spark.createDataFrame([("1531989196000",), ("2018-07-19T10:33:16.721+02:00",), ("never",)], "t string").select(C.metadata_time(F.col("t")).cast("string").alias("t"))
    assert [r.t for r in times.collect()] == ["2018-07-19 08:33:16", "2018-07-19 08:33:16.721", None]
    assert spark.createDataFrame([("a\\b/c.tar.gz",)], "p string").select(C.member_parts(F.col("p")).alias("m")).first().m[:] == ("a\\b", "c.tar.gz", ".gz")


def test_words_of_lines(spark):
    texts = ["has no line break char", "ge-val len--", "end -", "", None, "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.line_words(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [["has", "no", "line", "break", "char"], ["ge-val", "len-"], ["end-"], [], [], ["one"]]


def test_positions_of_words(spark):
    lines = spark.createDataFrame([("a b c",), ("a",)], "text string")
    got = {r.token: r[1:] for r in K.position_frequencies(K.line_tokens(lines, "word"), "word").collect()}
    assert got == {"a": (2, 2, 0, 1), "b": (1, 0, 1, 0), "c": (1, 0, 0, 1)}


def test_broken_words_are_mended(spark):
    rows = [(1, 0, "a remarkable"), (1, 1, "story of wonderful"), (1, 2, None), (1, 3, "things")]
    lines = spark.createDataFrame(rows, "doc int, n int, text string")
    broken = R.with_words(R.broken_lines(lines.where("text is not null"), ["doc"], "n"))
    assert "remar-" in broken.where("n = 0").first().text
    whole, ranges = R.paragraphs(broken, ["doc"], "n")
    text = whole.first().paragraph
    assert text == "a remarkable story of wonderful things"
    parts = [text[r.start : r.end] for r in ranges.orderBy("n").collect()]
    assert "".join(parts) == text


def test_model_of_word_breaks(spark):
    rows = [(1, i, t) for i, t in enumerate(["we saw the gevallen man again and"] * 3 + ["he was geval-", "len on the road"])]
    w = R.with_words(spark.createDataFrame(rows, "doc int, n int, text string"))
    freq = R.word_frequencies(w)
    cand = R.pair_candidates(R.line_pairs(w, ["doc"], ["n"]), freq)
    got = {(r.end_word, r.start_word): (r.merges, r.merge_word) for r in R.decide(cand, R.merge_classes(freq, R.merge_counts(cand)), R.mid_bigrams(w, freq)).collect()}
    assert got == {("and", "we"): (False, None), ("and", "he"): (False, None), ("geval-", "len"): (True, "gevallen")}
