import base64
import random

import pytest

from quirework.llm import bpe as B


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(B.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    tokens = B.read_ranks(B.VOCABULARY)
    return B.Encoder(tokens, B.split_table(tokens))


def test_pieces_as_by_merges(reference, encoder):
    rng = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr ", "aé漢🎉 \n\t", "01-=._/", "ab"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 3, 10, 40, 200])))
        assert encoder.encode_piece(text.encode()) == reference._encode_single_piece(text), text
    assert encoder.encode_piece(b"a" * 20_000) == reference._encode_single_piece("a" * 20_000)


def test_whole_table(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = B.encode(docs, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.decoded_ok and r.tokens == reference.encode_ordinary(r.text) and r.n_tokens == len(r.tokens)


def test_defined_results(spark, reference):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> é"), (3, "<|endoftext|> é"), (None, "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __text_2", "'a' as token")
    out = B.encode(df, keep=("doc_id", "token", "text"))
    got = out.collect()
    assert len(got) == 5
    for r in got:
        if r.doc_id == 1:
            assert (r.tokens, r.n_tokens, r.decoded_ok) == (None, None, None)
        else:
            assert r.decoded_ok and r.tokens == reference.encode_ordinary(r.text)
    back = B.decode(out.selectExpr("doc_id", "text as was", "tokens"), keep=("doc_id", "was"))
    assert all(r.text == r.was for r in back.collect())
    assert B.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        B.encode(df.withColumnRenamed("token", "tokens"), keep=("tokens",))


def test_kept_pieces_are_bounded_within_a_batch(reference):
    """A batch with more distinct pieces than are kept, and a text with more than that: same tokens, and few stay."""
    tokens = B.read_ranks(B.VOCABULARY)
    encoder = B.Encoder(tokens, B.split_table(tokens))
    texts = [" ".join(f"{k:x}q".translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(at, at + 1000)) for at in range(0, 260_000, 1000)]
    texts[1:1] = ["", " ".join(texts[:3])]
    ids, ends = encoder.encode_batch(texts)
    assert len(encoder) < 200_000 and len(encoder.compatible) <= B.KEPT_PAIRS
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == reference.encode_ordinary_batch(texts, num_threads=4)


def test_workers_keep_no_pieces_after_a_partition(spark):
    import pyarrow as pa

    def kept(batches):
        from quirework.llm import bpe

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, bpe._ENCODERS.values()))], pa.int64())], ["n"])

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).repartition(4)
    assert B.encode(docs).where("decoded_ok").count() == 20
    assert {r.n for r in spark.range(0, 32, 1, 32).mapInArrow(kept, "n long").collect()} == {0}
