import gzip
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirework.llm import media, warc

COLUMNS = [c.split()[0] for c in warc.SCHEMA.split(", ")]


def records(spark, rows):
    return spark.createDataFrame([(*r, None, None, p) for *r, p in rows], warc.SCHEMA)


def test_resolution(spark, tmp_path):
    rows = [
        ("b", "response", "u1", "2024-02", "sha1:x", b"same"),
        ("a", "response", "u2", "2024-01", "sha1:x", b"same"),
        ("c", "revisit", "u1", "2023-01", "sha1:x", None),
        ("d", "revisit", "u3", "2024-01", "sha1:gone", None),
        ("e", "response", "u4", "2024-01", None, b"own"),
        ("f", "response", "u5", "2024-03", None, b"own"),
        ("g", "response", "u6", None, None, None),
        ("h", "revisit", None, None, None, None),
        ("a", "response", "u2", "2024-01", "sha1:x", b"same"),
        (None, None, "u7", "2024-01", "sha1:y", b"\r\n\r\nWARC/1.1\r\n"),
    ]
    df = records(spark, rows).selectExpr("*", "1 as resolution", "2 as o", "3 as digest")
    heads = warc.write_resolved(df, str(tmp_path / "w")).collect()
    got = sorted((str(r.record_id), r.warc_type, r.refers_to, r.refers_to_date, r.resolution) for r in heads)
    own = "original"
    assert got == sorted(
        [
            ("a", "response", None, None, own), ("a", "revisit", "a", "2024-01", "duplicate"), ("b", "revisit", "a", "2024-01", "duplicate"), ("c", "revisit", "a", "2024-01", "revisit"),
            ("d", "revisit", None, None, "unresolved"), ("e", "response", None, None, own), ("f", "revisit", "e", "2024-01", "duplicate"), ("g", "response", None, None, own),
            ("h", "revisit", None, None, "unresolved"), ("None", "response", None, None, own),
        ], key=str)
    back = spark.read.format("warc").option("path", str(tmp_path / "w")).load()
    payloads = {r.record_id: bytes(r.payload) for r in back.where("warc_type = 'response'").collect()}
    assert payloads == {"a": b"same", "e": b"own", "g": b"", None: b"\r\n\r\nWARC/1.1\r\n"}
    assert back.count() == len(rows) and back.where("warc_type = 'revisit' and length(payload) > 0").count() == 0
    # a member can be read by its offset alone
    r = back.where("record_id = 'e'").first()
    with open(tmp_path / "w" / r.archive, "rb") as f:
        f.seek(r.offset)
        assert warc.parse_record(gzip.decompress(f.read(r.length)))["payload"] == b"own"
    assert not [p for p in (tmp_path / "w").iterdir() if not p.name.endswith(".warc.gz")]


def test_no_records(spark, tmp_path):
    assert warc.write_resolved(records(spark, [("a", "response", "u", "d", "x", b"")]).limit(0), str(tmp_path / "none")).count() == 0
    assert spark.read.format("warc").option("path", str(tmp_path / "none")).load().count() == 0


def test_all_pages_come_back(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = warc.query(spark, sf)
    assert out.count() == 2 * pages.count()
    assert out.where("warc_type = 'response'").count() == pages.select("html").distinct().count()


def test_media_round_trip(spark, tmp_path):
    rows = [(f"m{i}.png", bytes([i % 256]) * (i * 37 % 5000)) for i in range(200)] + [("e.txt", b""), (None, b"x"), ("n.txt", None), ("big.bin", b"ab" * 3_000_000), ("m1.png", b"again")]
    df = spark.createDataFrame(rows, "name string, payload binary").selectExpr("*", "1 as member", "2 as n")
    media.write_archives(df, str(tmp_path / "z"), name_col="name", payload_col="payload", archives=3)
    want = sorted((n, p) for n, p in rows if n and p is not None)
    for size in (2_000, 16 << 20):
        back = media.read(spark, str(tmp_path / "z"), rangeBytes=size, batchBytes=1000)
        assert sorted((r.member, bytes(r.payload)) for r in back.collect()) == want
    assert {r.media_type for r in back.where("member like 'm%'").collect()} == {"image/png"}
    assert media.read(spark, str(tmp_path / "nothing")).count() == 0
    media.write_archives(df.limit(0), str(tmp_path / "empty"), name_col="name", payload_col="payload", archives=2)
    assert media.read(spark, str(tmp_path / "empty")).count() == 0


def test_ranges_cover_every_member_once(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(50):
            z.writestr(f"f{i}", b"x" * i * 10)
    reader = media.MediaReader({"path": str(tmp_path), "rangebytes": "1000"})
    parts = reader.partitions()
    names = [r["member"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 5 and sorted(names) == sorted(f"f{i}" for i in range(50))


def test_a_second_write_adds_archives(spark, tmp_path):
    for name in ("m1", "m2"):
        df = spark.createDataFrame([(name, name.encode())], "name string, payload binary")
        media.write_archives(df, f"file://{tmp_path}/z", name_col="name", payload_col="payload", archives=1)
    assert sorted(bytes(r.payload) for r in media.read(spark, str(tmp_path / "z")).collect()) == [b"m1", b"m2"]
    left = tmp_path / "w" / "_part-000000-another-write"
    left.parent.mkdir()
    left.write_bytes(b"not finished")
    for name in ("r1", "r2"):
        warc.write_resolved(records(spark, [(name, "response", "u", "2024", None, name.encode())]), f"file://{tmp_path}/w")
    back = spark.read.format("warc").option("path", str(tmp_path / "w")).load()
    assert sorted((r.record_id, bytes(r.payload)) for r in back.collect()) == [("r1", b"r1"), ("r2", b"r2")]
    assert left.exists()


def test_long_payloads_and_clashing_names(spark, tmp_path):
    rows = [("a", "response", "u", "2024-01", None, b"x" * 9_000_000), ("b", "response", "u", "2024-02", None, b"x" * 9_000_000)]
    df = records(spark, rows).selectExpr("*", "1 as k", "2 as k2", "3 as p_key", "4 as __n")
    warc.write_resolved(df, str(tmp_path / "w"))
    back = spark.read.format("warc").option("path", str(tmp_path / "w")).load().collect()
    assert sorted((r.record_id, len(r.payload)) for r in back) == [("a", 9_000_000), ("b", 0)]


def test_a_file_that_can_t_be_opened_at_once(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("f", b"content")
    reader = media.MediaReader({"path": str(tmp_path), "retries": "2", "mode": "permissive"})
    tries = []

    def opening(path):
        tries.append(path)
        if len(tries) in (1, 2):
            raise OSError("away")
        return open(path, "rb")

    reader.open = opening
    assert [r["payload"] for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()] == [b"content"]


def test_members_are_tried_again_alone(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(5):
            z.writestr(f"f{i}", b"content" * 10)
    reader = media.MediaReader({"path": str(tmp_path), "retries": "2", "mode": "permissive"})
    opened = []

    class Flaky:
        def __init__(self, f):
            self.f = f

        def seek(self, at, whence=0):
            if len(opened) == 1 and at > 0:
                raise OSError("lost")
            return self.f.seek(at, whence)

        def __getattr__(self, name):
            return getattr(self.f, name)

    def opening(path):
        opened.append(path)
        return Flaky(open(path, "rb"))

    reader.open = opening
    rows = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert len(rows) == 5 and len(opened) == 2 and all(r["error"] is None and r["payload"] == b"content" * 10 for r in rows)


def test_broken_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(3):
            z.writestr(f"f{i}", b"content" * 10)
    path = Path(tmp_path / "a.zip")
    data = bytearray(path.read_bytes())
    at = media.directory(open(path, "rb"))[1].offset + 40
    data[at] ^= 255
    path.write_bytes(data)
    rows = {r.member: (r.payload, r.error) for r in media.read(spark, str(tmp_path), mode="permissive").collect()}
    assert rows["f1"][0] is None and "checksum" in rows["f1"][1]
    assert rows["f0"][1] is None and rows["f2"][1] is None
    with pytest.raises(Exception, match="checksum"):
        media.read(spark, str(tmp_path)).select(F.sum("n_bytes")).collect()
