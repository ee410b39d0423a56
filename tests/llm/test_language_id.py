import numpy as np
import pyarrow as pa

from quirework.llm import language_id as L

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and runs to the river", "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft zum Fluss"}


def _docs(spark, extra=()):
    rows = [(i, f"{TEXTS[lang]} {word}", lang) for i, (lang, word) in enumerate((x, w) for x in TEXTS for w in ("one", "two", "drei", "vier"))]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string")


def test_vectors_are_sums_of_bound_permuted_letters():
    s = L.Settings(dims=64)
    text = b"Ab cd"
    v, n = L.text_vectors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), s)
    letters = L.letter_vectors(s).astype(int)
    codes = [0, 1, 2, 0, 3, 4, 0]
    want = sum(np.roll(letters[codes[i]], 2) * np.roll(letters[codes[i + 1]], 1) * letters[codes[i + 2]] for i in range(len(codes) - 2))
    assert n[0] == 5 and (v[0] == want).all()


def test_batches_don_t_matter():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(rng.integers(97, 123)) for _ in range(n)) for n in rng.integers(0, 3000, 40)] + [None, "", "!!", "é" * 5000]
    s = L.Settings(dims=128)
    whole, _ = L.text_vectors(*L.string_buffers(pa.array(texts)), s)
    for i, t in enumerate(texts):
        one, _ = L.text_vectors(*L.string_buffers(pa.array([t], pa.string())), s)
        assert (one[0] == whole[i]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and length(text) > 50")
    got = L.identify(held, L.train(train)).join(docs.select("doc_id", "lang"), "doc_id").where("accepted").selectExpr("avg(cast(language = lang as double)) a", "count(*) n").first()
    assert got.n > 400 and got.a > 0.97


def test_defined_results(spark):
    extra = [(100, None, "en"), (101, "", None), (102, "12 !", None), (103, "the dog", None), (103, "the dog", None), (None, "the river", None), (104, "zqx jkv " * 5000, None), (105, "zqx jkv wq", None)]
    docs = _docs(spark, extra).selectExpr("*", "doc_id as i", "'x' as t", "1 as language")
    p = L.train(docs)
    got = {}
    for r in L.identify(docs, p).collect():
        got.setdefault(r.doc_id, []).append((r.language, r.accepted))
    assert got[100] == got[101] == got[102] == [(None, False)]
    assert got[103] == [("en", True)] * 2 and got[None] == [("en", True)]
    assert got[104][0][1] is False and got[105][0][1] is False  # one rule for long and short texts
    kept = L.keep_accepted(docs, p)
    assert kept.columns == docs.columns and kept.count() == 8 + 3
    empty = docs.limit(0)
    assert L.identify(empty, L.train(empty)).count() == 0
    assert not any(r.accepted for r in L.identify(docs, L.train(empty)).collect())


def test_against_brute_force(spark):
    """Prototypes, cosine, margin and acceptance by plain loops over letters and n-grams."""
    s = L.Settings(dims=96)
    letters = L.letter_vectors(s).astype(float)

    def vector(text):
        out, grams = np.zeros(s.dims), 0
        folded = [0]
        for c in text.lower().encode():
            code = c - 96 if 97 <= c <= 122 else c - 101 if c > 127 else 0
            if code or folded[-1]:
                folded.append(code)
        if folded[-1]:
            folded.append(0)
        for a, b, c in zip(folded, folded[1:], folded[2:]):
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
            grams += 1
        return out

    rng = np.random.default_rng(8)
    words = {"en": ["the", "house", "of", "stone", "Über"], "de": ["das", "Haus", "aus", "Stein", "ö"], "xx": ["zq", "qz"]}
    rows = [(i, " ".join(rng.choice(words[lang], 1 + i % 9)), lang) for i, lang in enumerate(list(words) * 30)] + [(200, "stone das 12", None), (201, "?", None)]
    docs = spark.createDataFrame([(i, t, lang if i % 2 else None) for i, t, lang in rows], "doc_id long, text string, lang string")
    names = sorted(words)
    proto = np.array([sum(vector(t) for i, t, lang in rows if lang == n and i % 2) for n in names])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    got = {r.doc_id: r for r in L.identify(docs, L.train(docs, s)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        v = vector(t)
        if not v.any():
            assert got[i].language is None and not got[i].accepted
            continue
        c = proto @ v / np.linalg.norm(v)
        order = np.sort(c)
        assert got[i].language == names[int(c.argmax())] and abs(got[i].cosine - order[-1]) < 1e-5 and abs(got[i].margin - (order[-1] - order[-2])) < 1e-5
        assert got[i].accepted == (order[-1] >= s.min_cosine)
