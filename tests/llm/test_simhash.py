import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quirework.llm import simhash as S
from quirework.llm._hashing import string_buffers, word_hashes

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10))) for _ in range(3000)]


def text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(t, k):
    words = t.split(" ")
    for i in rng.sample(range(len(words)), k):
        words[i] = rng.choice(VOCABULARY)
    return " ".join(words)


def test_words_hash_alike_wherever_they_stand():
    texts = ["Abc, déf abc", None, "", "...", "abc " + "x" * 100, "x" * 100]
    h, first = word_hashes(*string_buffers(pa.array(texts)))
    assert first.tolist() == [0, 3, 3, 3, 3, 5, 6]
    assert h[0] == h[2] == h[3] and h[4] == h[5] and h[0] != h[1]


def test_every_pair_within_the_guarantee_meets():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    near = base.copy()
    for i in range(300):
        for bit in r.choice(128, int(r.integers(0, 12)), replace=False):
            near[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    fp = np.concatenate([base, near])
    keys = S.posting_keys(fp)
    x, y = S.list_edges(keys.ravel(), np.repeat(fp, keys.shape[1], axis=0))
    found = {frozenset((i // keys.shape[1], j // keys.shape[1])) for i, j in zip(x, y)}
    assert all(frozenset((i, i + 300)) in found for i in range(300))
    assert all((S.distance(fp[i], fp[j]) <= S.MAX_DISTANCE) for i, j in (tuple(f) for f in found if len(f) == 2))
    # each pair is taken once, in one list
    assert len(x) == len({(i, j) for i, j in zip(x // keys.shape[1], y // keys.shape[1])})


def test_groups_against_brute_force(spark):
    rows, i = [], 0
    for _ in range(60):
        t = text(rng.randrange(40, 200))
        rows.append((i, t))
        for _ in range(rng.choice([0, 0, 1, 3])):
            i += 1
            rows.append((i, rng.choice([t, t.upper(), changed(t, 1)])))
        i += 1
    big = text(150)
    rows += [(i + k, changed(big, 1)) for k in range(120)]  # a group larger than the short lists
    got = S.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps, _ = S.fingerprints(*string_buffers(pa.array([t for _, t in rows])))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = S.posting_keys(fps)
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] == fps[b]).all() or ((keys[a] == keys[b]).any() and S.distance(fps[a], fps[b]) <= S.MAX_DISTANCE):
                root[max(find(a), find(b))] = min(find(a), find(b))
    sets = {}
    for a in range(len(rows)):
        sets.setdefault(find(a), set()).add(rows[a][0])
    want = {frozenset(s) for s in sets.values() if len(s) > 1}
    found = {}
    for r in got:
        found.setdefault(r.group_id, set()).add(r.id)
        assert r.kept == (r.id == r.group_id)
    assert {frozenset(s) for s in found.values()} == want
    assert all(min(s) == g for g, s in found.items())


def test_planted_copies(spark):
    clean = [(i, text(120)) for i in range(300)]
    copies = [(1000 + i, changed(clean[i][1], 2) if i % 2 else clean[i][1]) for i in range(100)]
    found = {r.id: r.group_id for r in S.groups(spark.createDataFrame(clean + copies, "doc_id long, text string")).collect()}
    assert sum(found.get(1000 + i) == i for i in range(100)) >= 90
    assert not [i for i in range(100, 300) if i in found]


def test_defined_results(spark):
    t = text(50)
    rows = [(1, t), (2, t), (1, t), (None, t), (3, None), (4, ""), (5, "--"), (6, ""), (7, text(50) * 2000), (8, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as unit", "3 as fp", "4 as root")
    out = S.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 4, 5, 6, 7, 8]
    assert S.drop_near_copies(df.limit(0)).count() == 0
    groups = S.groups(df.where(F.col("text") == t))
    assert sorted(((r.id, r.group_id, r.group_size, r.kept) for r in groups.collect()), key=str) == sorted([(1, 1, 4, True), (1, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False)], key=str)


def test_a_partition_of_postings_is_compared_in_bounded_memory():
    """Two workers of an executor do so at once, beside a heap that has most of its memory."""
    fp = np.random.default_rng(2).integers(0, 1 << 63, (S.POSTINGS_PER_PARTITION // (S.BLOCKS * len(S._COMBOS)), 2)).astype(np.uint64)
    keys = S.posting_keys(fp)
    each = np.repeat(fp, keys.shape[1], axis=0)
    tracemalloc.start()
    try:
        S.list_edges(keys.ravel(), each)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
