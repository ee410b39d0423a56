import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quirework.llm import chat, kdtree, mixing, sharding


def jump_one(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, -1, 1 << 62, -(1 << 63), *range(500)], np.int64)
    for n in (1, 2, 10, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]
    many = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 100_000)
    a, b = sharding.jump(many, 100), sharding.jump(many, 125)
    assert ((a == b) | (b >= 100)).all() and abs((a != b).mean() - 0.2) < 0.01
    assert np.bincount(a).std() / np.bincount(a).mean() < 0.1


def test_sharding_defined_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (7, None)], "doc_id long, k string")
    got = sharding.assign(df, "doc_id", {"shard": 10}).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter({(1, jump_one(1, 10)): 2, (None, None): 1, (7, jump_one(7, 10)): 1})
    assert sharding.assign(df, "k", {"shard": 3}).where("k is null and shard is null").count() == 1
    assert sharding.assign(df.limit(0), "doc_id", {"shard": 3}).count() == 0
    big = spark.createDataFrame([(2**62 + 1, "x"), (None, "y")], "doc_id long, k string")
    sharding.write_shards(big, "doc_id", 100, str(tmp_path / "s"))
    back = {r.k: r.shard for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert back == {"x": jump_one(2**62 + 1, 100), "y": None}


def test_chat_against_plain_strings(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 6)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", "sysé", None]), rng.choice([None, "", "hi", "é漢" * rng.randrange(50), "<|im_end|>"])))
    rows += rows[:5] + [(99, 1, "assistant", "x" * 6_000_000), (99, 2, "user", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as chat", "2 as spans")
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r, x))
    key = lambda v: tuple((x is not None, x.encode() if isinstance(x, str) else x) for x in v)
    out = chat.format_chats(df).collect()
    assert len(out) == len(want)
    for r in out:
        turns = sorted(want[r.conv_id], key=key)
        text = "".join(f"<|im_start|>{'unknown' if role is None else role}\n{x or ''}<|im_end|>\n" for _, role, x in turns)
        assert (r.n_turns, r.chat) == (len(turns), text)
        data = text.encode()
        assert [data[s.start : s.start + s.size].decode() for s in r.spans] == [x or "" for _, role, x in turns if role == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def brute(points, k):
    out = {}
    for i, p in points.items():
        d = sorted((float(((np.array(p, np.float64) - np.array(q, np.float64)) ** 2).sum()), j) for j, q in points.items() if j != i)
        out[i] = [(j, round(x**0.5, 9)) for x, j in d[:k]]
    return out


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(4)
    points = {int(i): rng.normal(size=8).round(1).tolist() for i in range(300)}
    points |= {1000 + i: points[i] for i in range(40)}  # ties
    rows = list(points.items()) + [(5, points[5]), (None, points[1]), (2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [1.0]), (2003, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "2 as id")
    for per_shard, leaf in ((10_000, 16), (40, 8)):
        got = defaultdict(list)
        for r in kdtree.nearest(df, k=5, rows_per_shard=per_shard, leaf=leaf).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.neighbour_id, round(r.distance, 9)))
        assert got == brute(points, 5)


def test_knn_of_some_queries(spark):
    """Queries apart from the rows, ids that are strings, and blocks of queries."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 20
    points = {f"v{i:04d}": (centres[i % 6] + rng.normal(size=4)).astype(np.float32).tolist() for i in range(400)}
    df = spark.createDataFrame(list(points.items()), "i string, v array<float>")
    asked = [("v0003", points["v0003"]), ("new", [0.0] * 4), ("far", [1e6] * 4), (None, [0.0] * 4), ("short", [1.0])] + [(k, points[k]) for k in list(points)[::9]]
    queries = spark.createDataFrame(asked, "i string, v array<float>")
    want = {}
    for name, q in asked:
        if name is not None and len(q) == 4:
            d = sorted((float(((np.array(q, np.float64) - np.array(p, np.float64)) ** 2).sum()), j) for j, p in points.items() if j != name)
            want[name] = [(j, round(x**0.5, 6)) for x, j in d[:3]]
    for block in (7, 1000):
        got = defaultdict(list)
        for r in kdtree.nearest(df, queries, k=3, id_col="i", vec_col="v", rows_per_shard=50, queries_per_block=block, leaf=8).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.neighbour_id, round(r.distance, 6)))
        assert got == want


def test_near_boxes():
    rng = np.random.default_rng(6)
    low = rng.normal(size=(13, 3))
    high = low + rng.random((13, 3))
    q, kth = rng.normal(size=(50, 3)) * 2, rng.random(50) * 2
    tree = kdtree.BoxTree(low, high)
    got = set(zip(*(x.tolist() for x in tree.near(q, kth))))
    d = np.maximum(low[None] - q[:, None], 0) + np.maximum(q[:, None] - high[None], 0)
    assert got == set(zip(*(x.tolist() for x in np.nonzero((d * d).sum(2) <= kth[:, None]))))
    assert kdtree.BoxTree(np.zeros((0, 3)), np.zeros((0, 3))).near(q[:0], kth[:0])[0].size == 0


def test_knn_small_tables(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kdtree.nearest(df).orderBy("query_id").collect()] == [(1, 1, 2, 3.0), (2, 1, 1, 3.0)]
    assert kdtree.nearest(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert kdtree.nearest(same, k=3, rows_per_shard=10, leaf=4).where("distance = 0").count() == 150


def test_pivotal_rounding_keeps_sums_and_means():
    rng = np.random.default_rng(0)
    p = rng.random(41)
    total = np.zeros(41)
    for _ in range(4000):
        v, at = mixing.pivotal(p, rng.random(41))
        whole = np.delete(v, at) if at >= 0 else v
        assert set(np.unique(whole)) <= {0.0, 1.0} and abs(v.sum() - p.sum()) < 1e-9
        total += v
    assert np.abs(total / 4000 - p).max() < 0.04


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "UNITS_PER_BUCKET", 30)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(i, "a" if i % 5 else "b") for i in range(1000)] + [(None, None), (2000, None), (2001, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 as copies", "2 as id", "3 as bucket")
    weights = {"a": 0.5, "b": 0.3, None: 0.2}
    d = mixing.copies(docs, weights, 2500.0)
    sums = {r[0]: r[1] for r in d.groupBy("source").agg(F.sum("copies")).collect()}
    assert abs(sums["a"] - 1250) <= 1 and abs(sums["b"] - 750) <= 1 and abs(sums[None] - 500) <= 1 and sums["none"] == 0
    spread = {r[0]: (r[1], r[2]) for r in d.groupBy("source").agg(F.min("copies"), F.max("copies")).collect()}
    assert spread["a"] == (1, 2) and spread["b"] == (3, 4) and spread[None] == (250, 250)
    assert sorted(map(tuple, d.collect()), key=str) == sorted(map(tuple, mixing.copies(docs.repartition(7), weights, 2500.0).collect()), key=str)
    assert mixing.repeat_rows(docs, d).groupBy("source").count().where("source = 'a'").first()[1] == sums["a"]
    counts = mixing.source_counts(docs)
    flat = mixing.flattened_weights(counts)
    least = mixing.copies(docs, flat, mixing.total_without_loss(counts, flat), counts=counts).agg(F.min("copies")).first()[0]
    assert least >= 1
    assert mixing.copies(docs.limit(0), weights, 10.0).count() == 0
