import random

from quirework.llm import line_dedup as L


def words(line):
    return 0 if line.strip(" ") == "" else line.count(" ") + 1


def brute(rows, min_words):
    """(deleted lines, text left) by (id, text); rows have distinct ids."""
    texts = sorted(((i, t.split("\n")) for i, t in rows if t is not None), key=lambda x: x[0])
    where: dict[str, list] = {}
    for d, (_, lines) in enumerate(texts):
        for at, line in enumerate(lines):
            where.setdefault(line, []).append((d, at))
    out = {}
    for d, (i, lines) in enumerate(texts):
        gone = set()
        for at in range(len(lines)):
            best = 0
            for e, p in where[lines[at]]:
                if (e, p) >= (d, at):
                    continue
                n = 0
                while at + n < len(lines) and p + n < len(texts[e][1]) and lines[at + n] == texts[e][1][p + n]:
                    n += 1
                best = max(best, n)
            if best and sum(map(words, lines[at : at + best])) >= min_words:
                gone |= set(range(at, at + best))
        kept = [x for n, x in enumerate(lines) if n not in gone]
        out[i] = (len(gone), "\n".join(kept) if kept else None)
    return out


def edited(spark, rows, min_words, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    out = L._edited(df, "doc_id", "text", min_words)
    got = out.selectExpr("doc_id", "__qw_deleted", "case when __qw_left > 0 then text end t").collect()
    return {r[0]: (r[1], r[2]) for r in got if r[1] or r[2] is not None}


def test_against_brute_force(spark):
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 3, 6]))) for _ in range(12)]
    passages = [[rng.choice(lines) for _ in range(n)] for n in (3, 5, 9, 17, 40, 70)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(rng.randrange(5)):
            t += rng.choice(passages)[: rng.choice([2, 4, 16, 99])] if rng.random() < 0.7 else [f"only {i} {rng.random()}", rng.choice(lines)]
        rows.append((i, "\n".join(t)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 3)]  # exact copies
    rng.shuffle(rows)
    for min_words in (1, 8, 25):
        assert edited(spark, rows, min_words) == brute(rows, min_words)


def test_long_runs_of_lengths_around_powers(spark):
    base = [f"line {i} a b" for i in range(300)]
    rows = [(i, "\n".join(base[:n])) for i, n in enumerate([300, 4, 8, 16, 17, 64, 65, 256, 255, 299, 3])]
    rows += [(50 + i, "\n".join([f"own {i}", *base[n : n + 32], f"end {i}"])) for i, n in enumerate([0, 7, 16, 100])]
    assert edited(spark, rows, 10) == brute(rows, 10)


def test_defined_results(spark):
    long = "\n".join("five words on a line" for _ in range(8))
    rows = [(1, long + "\nfirst"), (2, "second\n" + long), (2, "second\n" + long), (3, None), (4, ""), (None, long + "\nfirst"), (5, long + "\nfirst")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as k", "1 as at", "'x' as h", "length(text) as n_chars")
    out = L.drop_repeated_runs(df, count_col="n_chars")
    assert out.columns == df.columns
    got = sorted(((r.doc_id is None, r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    # a run within one document counts, too: of eight equal lines, those from the second on repeat seven
    assert got == sorted([(False, 1, "five words on a line\nfirst", 26), (False, 2, "second", 6), (False, 2, "second", 6), (False, 3, None, None), (False, 4, "", 0)], key=str)
    assert L.drop_repeated_runs(df.limit(0)).count() == 0


def test_short_copies_stay(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, "x\ny")]
    assert edited(spark, rows, 25) == {1: (0, "a b c"), 2: (0, "a b c"), 3: (0, "x\ny")}
