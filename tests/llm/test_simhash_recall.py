import random

import numpy as np
import pyarrow as pa

from quirework.llm import simhash as S
from quirework.llm._hashing import string_buffers


def test_every_pair_within_max_distance_meets():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, (600, 2)).astype(np.uint64)
    near = base.copy()
    for i in range(600):
        for bit in r.choice(128, 12 + i % (S.MAX_DISTANCE - 11), replace=False):
            near[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    fp = np.concatenate([base, near])
    keys = S.posting_keys(fp)
    assert (keys[:600] == keys[600:]).any(1).all()
    x, y = S.list_edges(keys.ravel(), np.repeat(fp, keys.shape[1], axis=0))
    found = {frozenset((i // keys.shape[1], j // keys.shape[1])) for i, j in zip(x, y)}
    assert all(frozenset((i, i + 600)) in found for i in range(600))


def test_groups_against_all_pairs(spark):
    """Of edited copies at any distance, no candidate filter in the comparison."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10))) for _ in range(3000)]
    rows = []
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 150))]
        rows.append((len(rows), " ".join(words)))
        for k in rng.sample(range(2, 16), 2):
            edited = list(words)
            for i in rng.sample(range(len(words)), k):
                edited[i] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(edited)))
    fps, _ = S.fingerprints(*string_buffers(pa.array([t for _, t in rows])))
    root = list(range(len(rows)))
    far = 0
    for a in range(len(rows)):
        for b in range(a):
            d = S.distance(fps[a], fps[b])
            far += 11 < d <= S.MAX_DISTANCE
            if d <= S.MAX_DISTANCE and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert far > 50
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add(i)
    found = {}
    for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.group_id, set()).add(r.id)
    assert found == {r: s for r, s in want.items() if len(s) > 1}
