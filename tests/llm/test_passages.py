import random
import re

from quirework.llm import line_dedup as L


def brute(rows, min_words):
    """(deleted words, words left) by id: a word goes with any window of words that stands earlier."""
    texts = sorted((i, re.split(r"[ \n]+", t.strip(" \n"))) for i, t in rows)
    seen, out = set(), {}
    for i, words in texts:
        gone = set()
        for at in range(len(words) - min_words + 1):
            window = tuple(words[at : at + min_words])
            if window in seen:
                gone |= set(range(at, at + min_words))
            seen.add(window)
        out[i] = (len(gone), [w for n, w in enumerate(words) if n not in gone] or None)
    return out


def left(spark, rows, min_words):
    out = L._without_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", min_words)
    got = out.selectExpr("doc_id", "__qw_deleted", "case when __qw_left > 0 then text end t").collect()
    return {r[0]: (r[1], r[2].split() if r[2] is not None else None) for r in got}


def test_passages_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}é" for i in range(40)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(n) for n in (24, 25, 26, 60, 300)] + [["ha"] * 80]
    rows = []
    for i in range(80):
        t = words(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            t += p[a : rng.randrange(a, len(p)) + 1] + words(rng.randrange(20))
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n"]) for w in t).strip() or "alone"))
    rows += [(100 + i, rows[i][1]) for i in range(0, 80, 3)]
    for min_words in (1, 8, 25):
        assert left(spark, rows, min_words) == brute(rows, min_words)


def test_passage_within_lines(spark):
    """A passage that begins and ends inside lines goes, wherever its lines are broken."""
    p = [f"p{i}" for i in range(50)]
    rows = [(1, "own one " + " ".join(p) + " stops one"), (2, "own two\nbegins " + " ".join(p[:30]) + "\n" + " ".join(p[30:]) + " end\ntwo"), (3, "own three\n" + " ".join(p) + " goes on")]
    out = L.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "own two\nbegins end\ntwo", 3: "own three\ngoes on"}


def test_texts_are_edited_once(spark):
    """Dropping the texts that lose all words runs the edit in one worker, not in a second one for the filter."""
    t = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, t, 1), (2, t, 1), (3, "a " + t + " b", 1), (4, None, 1)], "doc_id long, text string, n_chars long")
    out = L.drop_repeated_runs(docs, count_col="n_chars")
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(map(tuple, out.collect())) == [(1, t, 1), (3, "a b", 3), (4, None, 1)]
