from collections import Counter

from quirework.llm import warc


def test_every_record_and_payload_is_kept(spark, tmp_path):
    rows = [
        ("a", "response", "u1", "2024-01", "sha1:x", None),  # the earliest of its digest, without the payload
        ("b", "response", "u1", "2024-02", "sha1:x", b"content"),
        ("a", "response", "u1", "2024-01", "sha1:x", None),
        ("n", "response", "u2", "2024-01", None, None),
        ("n", "response", "u2", "2024-01", None, None),
        (None, "response", "u3", None, None, None),
        (None, "response", "u4", None, None, None),
        ("c", "response", "u5", "2024-01", "sha1:none", None),  # no payload anywhere
        ("d", "response", "u5", "2024-02", "sha1:none", None),
        ("e", "response", "u6", "2024-01", "sha1:y", None),  # a record repeated with and without its payload
        ("e", "response", "u6", "2024-01", "sha1:y", b"other"),
    ]
    df = spark.createDataFrame([(*r, None, None, p) for *r, p in rows], warc.SCHEMA)
    heads = warc.write_resolved(df, str(tmp_path / "w")).collect()
    assert len(heads) == len(rows)
    kinds = Counter((r.record_id, r.resolution, r.refers_to) for r in heads)
    assert kinds == Counter({("a", "duplicate", "b"): 2, ("b", "original", None): 1, ("n", "original", None): 2, (None, "original", None): 2, ("c", "original", None): 1, ("d", "duplicate", "c"): 1, ("e", "original", None): 1, ("e", "duplicate", "e"): 1})
    back = spark.read.format("warc").option("path", str(tmp_path / "w")).load().collect()
    assert Counter((r.record_id, r.target_uri) for r in back) == Counter((r[0], r[2]) for r in rows)
    assert sorted(bytes(r.payload) for r in back if r.payload) == [b"content", b"other"]
