"""Searches and statistics of whole tables: any language, any letters, every word."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.functions import custom as C
from quirework.functions import text as T
from quirework.operators import search as S
from quirework.plans import catalogue

Q = catalogue.queries()
DOCS = "doc_id long, source string, lang string, text string"


def test_analyses_of_all_languages(spark, tmp_path):
    rows = [(1, "s", "en", "one two three"), (2, "s", "fr", "un two\nUN"), (3, "s", None, "two alone"), (4, "s", "de", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.token: (r.all_freq, r.start_freq, r.mid_freq, r.end_freq) for r in Q["merged_analyses"](spark, str(tmp_path)).collect()}
    assert got == {"one": (1, 1, 0, 0), "two": (3, 1, 1, 1), "three": (1, 0, 0, 1), "un": (2, 2, 0, 1), "alone": (1, 0, 0, 1)}


LINES = ["I say that thé thaw, naïve théâtre that", "the plain line that ends", "über den Thüringer Wald, that is all", "ça that", "nothing here", "", "that that a that bath than the", "  that - it_th is that's", "a b c d e that f g h that i j k l m n that"]


def test_search_of_all_lines_against_brute_force(spark, tmp_path):
    rows = [(i, "s", lang, "\n".join(LINES[i:] + LINES[:i])) for i, lang in enumerate(["en", "de", "fr", None])] + [(9, "s", "en", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))

    def brute(term):
        for i, _, _, text in rows:
            for n, line in enumerate((text or "").split("\n")):
                for hit, m in enumerate(re.finditer(rf"((?:\w+\W+){{0,3}})\b({term})\b((?:\W+\w+){{0,3}})", line, re.I), 1):
                    yield i, n, hit, *m.groups(), m.start()

    that, wild = list(brute("that")), list(brute(r"th\w*"))
    got = Q["kwic"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.line_no, r.hit, r.pre, r.term_match, r.post, r.match_offset) for r in got) == Counter(that)
    got = Q["kwic_wildcard"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.line_no, r.hit, r.pre, r.term_match, r.post) for r in got) == Counter(w[:-1] for w in wild)
    got = Q["kwic_match_freq"](spark, str(tmp_path)).collect()
    assert {r.term_match: r.freq for r in got} == Counter(w[4] for w in wild)


@pytest.mark.parametrize("blocks", [(1_000, 50_000), (7, 11)])
def test_every_word_is_a_query(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(S, "QUERIES_PER_BLOCK", blocks[0])
    monkeypatch.setattr(S, "WORDS_PER_BLOCK", blocks[1])
    text = "a that thát That thatch hatch\nscratch catch cat é ab ba aba bab " + " ".join(f"x{i}y{i % 7}" for i in range(60))
    spark.createDataFrame([(20, "s", "en", text), (2, "s", None, "cat caterpillar"), (3, "s", "de", None)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    words = sorted(set(text.split()) | {"caterpillar"})

    def grams(w):
        w = f"#{w.lower()}#"
        return {w[i] + w[i + d] for d in (1, 2) for i in range(len(w) - d)}

    want = []
    for q in set(text.split()):
        scored = [(-len(grams(q) & grams(t)) / (len(grams(q)) * len(grams(t))) ** 0.5, t) for t in words if grams(q) & grams(t)]
        want += [(q, rank, t, round(-s, 6)) for rank, (s, t) in enumerate(sorted(scored)[:10], 1)]
    got = Q["similar_words"](spark, str(tmp_path)).collect()
    assert sorted((r.query, r.rank, r.token, r.score) for r in got) == sorted(want)
    vocabulary = spark.createDataFrame([(w,) for w in words], "token string")
    joined = S.similar_words(vocabulary.withColumnRenamed("token", "query"), vocabulary).collect()
    assert sorted(map(tuple, S.similar_vocabulary(vocabulary).collect())) == sorted(map(tuple, joined))
    assert S.similar_vocabulary(vocabulary.limit(0)).count() == 0


def plain_words(line: str) -> list[str]:
    if line.endswith("--"):
        line = line[:-1]
    elif line.endswith(" -"):
        line = line[:-2] + "-"
    out, before = [], None
    for t in re.findall(r"\w+|\W+", line):
        if before is None:
            out.append(t)
        elif t[0] == "-" and before[0].isalpha():
            out[-1] += t.strip()
        elif t[0].isalpha() and before[-1] == "-":
            out[-1] += t
        elif t != " ":
            out.append(t.strip())
        before = t
    return out


def test_words_of_lines_against_plain_code(spark):
    import random

    rng = random.Random(3)
    lines = ["".join(rng.choice(["a", "bé", "X1", "7", "-", "--", " ", "  ", ". ", ", ", "- ", " -", "_", "\t", "'"]) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    lines += ["", " ", "-", "--", " -", "a --", "a- ", "-a", " a", "a  b", "a ", "word-", "one two-three"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    for r in df.select("t", T.line_words(F.col("t")).alias("w")).collect():
        assert r.w == (plain_words(r.t) if r.t else []), r.t
    assert df.select(T.line_words(F.lit(None).cast("string")).alias("w")).first().w == []


def test_custom_tags_of_odd_strings(spark):
    odd = ["a {k:1; k:2;} b{x:1:2;y : z ;:}", "", None, "c {} d {offset:1; length:x; index: 3}", "e {no; offset:4"]
    got = [[(t.tag_name, t["offset"], t["length"], t["index"], dict(t.attrs)) for t in r.t or []] for r in spark.createDataFrame([(i, o) for i, o in enumerate(odd)], "i int, o string").select(C.custom_tags(F.col("o")).alias("t")).collect()]
    assert got == [[("a", None, None, None, {"k": "2"}), ("b", None, None, None, {"y": "z", "": ""})], [], [], [("c", None, None, None, {}), ("d", 1, None, 3, {"offset": "1", "length": "x", "index": "3"})], []]
