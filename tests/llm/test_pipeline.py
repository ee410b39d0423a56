import importlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from quirework.llm import bpe, registry

NAMES = ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_"]


def _documents(spark, tmp_path, rows, name="documents"):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_registry():
    names = list(registry.queries())
    assert sorted(n.partition("_")[0] + "_" for n in names) == sorted(NAMES)
    assert set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", *names} <= set(entry.queries())


def test_stages_keep_columns_and_decide(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        kept = out.select("doc_id").distinct()
        assert kept.join(now, "doc_id", "left_anti").isEmpty()
        now = P.materialise(out, "test")
    last = P.STAGES[-1][1](spark, now, sf)
    assert last.count() == now.count() and last.where("not decoded_ok").isEmpty()
    run = P.run(spark, sf)
    key = lambda df: Counter((r.doc_id, tuple(r.tokens)) for r in df.collect())
    assert key(run) == key(last)


def test_planted_cases(spark, tmp_path):
    import random

    rng = random.Random(1)
    vocabulary = {"en": ["the", "of", "house", "river", "walking", "that", "with", "stone", "green", "paper", "under", "light"], "fr": ["le", "la", "maison", "rivière", "avec", "que", "pierre", "verte", "papier", "sous", "lumière", "des"]}
    words = {lang: v + ["".join(rng.sample("".join(v), 6)) for _ in range(300)] for lang, v in vocabulary.items()}
    line = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(12))
    body = lambda lang, n=10: "\n".join(line(lang) for _ in range(n))
    rows = [(i, body(lang), lang, f"s{i % 3}") for i, lang in enumerate(["en", "fr"] * 60)]
    passage = body("en", 6)
    rows += [(200 + i, body("en", 3) + "\n" + passage + "\n" + body("en", 3), "en", "s1") for i in range(4)]
    rows += [(300, rows[0][1], "en", "s2"), (301, rows[1][1].replace(rows[1][1].split(" ")[5], "neu", 1), "fr", "s2")]
    rows += [(400, "%&/ 12 %%", None, "s1"), (401, None, "en", "s1"), (402, "", "en", None), (403, "zxq wvk qqj xzz kwv " * 60, None, "s1")]
    sf = _documents(spark, tmp_path, [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows])
    out = P.run(spark, sf).collect()
    texts = {}
    tokens = bpe.read_ranks(bpe.VOCABULARY)
    for r in out:
        texts[r.doc_id] = b"".join(tokens[i] for i in r.tokens).decode()
    assert {300, 400, 401, 402, 403} & set(texts) == set()
    assert 301 not in texts  # a near copy by its text before line dedup
    assert sum(passage in t for t in texts.values()) == 1 and passage in texts[200]
    assert texts[201].count("\n") == 5
    assert all(texts[i] == t for i, t, *_ in rows[:120])


def test_documents_that_aren_t_what_is_left_of_the_table_stay(spark, tmp_path):
    """Ids that mean other texts in the folder's table, null and repeated ids: near-dedup goes by the texts it gets."""
    long = lambda k: " ".join(f"w{k}x{i}" for i in range(120))
    sf = _documents(spark, tmp_path, [(i, long(0), "en", "s", 1) for i in range(8)])
    rows = [(i, long(i + 1), "en", "s", 1) for i in range(4)] + [(4, long(0), "en", "s", 1), (5, long(0).replace("w0x7 ", ""), "en", "s", 1), (6, long(0)[:300].rpartition(" ")[0], "en", "s", 1), (6, long(9), "en", "s", 1), (None, long(10), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"k": F.lit(1), "id": F.lit(2), "root": F.lit(3)})
    out = dict(P.STAGES)["simhash_near_dedup"](spark, docs, sf)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([0, 1, 2, 3, 4, 6, 6, None])


def test_empty_documents(spark, tmp_path):
    sf = _documents(spark, tmp_path, [])
    assert P.run(spark, sf).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"k": F.lit(1), "unit": F.lit(2), "copies": F.lit(3)})
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
