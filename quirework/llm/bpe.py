"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick automaton over the vocabulary finds the longest token at
every position of a piece in one pass. The encoder takes the longest token, checks that it is compatible with the token
before it (two tokens may stand side by side only if merging their bytes by rank would leave the border between them
alone; memoised), else tries the next shorter token, else steps back. The first sequence that reaches the end is exactly
what the rank-ordered merges give, without running them.

Pieces come from the tokenizer's pattern; the encodings of pieces are kept between the documents of a partition (dropped
and begun anew after the text in which they get many or long), and whether pairs of tokens fit in a table of fixed size.

Defined results: a null text gives null tokens; an empty text an empty list; texts are encoded whole, however long; the
strings of special tokens are ordinary text; repeated rows give repeated results; other columns are kept by
`encode` if asked for and may have any name but those of the results.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_slices, trimmed
from ._hashing import string_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: bytes of pieces and their encodings, about, that a worker keeps at most; after that text it starts again with none
KEPT_BYTES = 32 << 20
#: bytes that a kept piece takes besides its characters and tokens
_PIECE_BYTES = 150
#: pairs of tokens of which a worker remembers whether they fit at most, a power of 2
KEPT_PAIRS = 1 << 18
#: bytes of text that are encoded at a time
SLICE = 1 << 19
_NO_LIMIT = 1 << 62


def read_ranks(path: str) -> list[bytes]:
    """The tokens by rank from a file with lines of base64 and rank."""
    import base64

    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def split_table(tokens: list[bytes]) -> list[tuple[int, int]]:
    """For each token the two tokens of its last merge; for a token that isn't a merge, itself twice."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = []
    for i, t in enumerate(tokens):
        if len(t) == 1:
            out.append((i, i))
            continue
        parts = [t[k : k + 1] for k in range(len(t))]
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append((rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (i, i))
    return out


class Encoder(dict):
    """Piece -> index into the kept encodings; a missing piece is encoded when it is asked for."""

    def __init__(self, tokens: list[bytes], splits: list[tuple[int, int]], pattern: str = PATTERN):
        super().__init__()
        self.tokens, self.splits = tokens, splits
        self.length = [len(t) for t in tokens]
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        rank = {t: i for i, t in enumerate(tokens)}
        self.rank = rank
        self.pair = {s: i for i, s in enumerate(splits) if s[0] != i}
        # the longest shorter token that a token begins with
        self.shorter = [next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1) for t in tokens]
        # at a pair's place twice its number, and 1 more if it fits; pairs with the same place replace each other
        self.compatible = array("q", [-1]) * KEPT_PAIRS
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.flat, self.sizes, self.kept = array("i"), array("i"), 0

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens would leave the border between them."""
        limit, pair, splits = _NO_LIMIT, self.pair, self.splits
        while True:
            if pair.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                left = splits[left][1]
                if left == limit:
                    limit = right + 1
                    right = splits[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = splits[right][0]
                if right + 1 == limit:
                    limit = left
                    left = splits[left][1]
                    if left == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        length, shorter, compatible = self.length, self.shorter, self.compatible
        n, many, mask = len(piece), len(self.tokens), KEPT_PAIRS - 1
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest stays
        out: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if open_[end]:
                    if last < 0:
                        break
                    pair = last * many + token
                    known = compatible[pair & mask]
                    if known >> 1 != pair:
                        known = compatible[pair & mask] = 2 * pair + self._fits(last, token)
                    if known & 1:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def __missing__(self, piece: str) -> int:
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        k = self[piece] = len(self.sizes)
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        self.kept += _PIECE_BYTES + len(piece) + 4 * len(ids)
        return k

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all token ids, offsets by text)."""
        get, findall = self.__getitem__, self.findall
        parts, done, totals = [], [], []
        for k, text in enumerate(texts):
            pieces = findall(text)
            parts.append(np.fromiter(map(get, pieces), np.int32, len(pieces)))
            if self.kept > KEPT_BYTES or k + 1 == len(texts):
                ids, sizes = self._gather(parts)
                done.append(ids)
                totals.append(sizes)
                parts = []
                if self.kept > KEPT_BYTES:
                    self._forget()
        ids = np.concatenate(done) if done else np.zeros(0, np.int32)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate(totals) if totals else np.zeros(0, np.int64))])

    def _gather(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of texts whose pieces have these indices, number of ids by text)."""
        index = np.concatenate(parts)
        sizes = np.array(self.sizes, np.int64)
        flat = np.array(self.flat, np.int32)
        starts = np.cumsum(sizes) - sizes
        own = sizes[index]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat(starts[index] - ends[:-1], own) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum([len(p) for p in parts])])])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Decoder:
    """Token ids to bytes by one gather over the vocabulary's bytes."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts whose tokens lie at `offsets` in `ids`."""
        own = self.size[ids]
        ends = np.cumsum(own)
        data = self.data[np.repeat(self.start[ids] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        return data, np.concatenate([[0], ends])[offsets]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(key: tuple, vocabulary) -> Encoder:
    if key not in _ENCODERS:
        tokens, splits = vocabulary.value
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokens, splits, key[1])
    return _ENCODERS[key]


def encode(df: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns `keep`, then tokens, n_tokens and decoded_ok (the tokens decode to exactly the text's bytes).

    `vocabulary` is read by the driver and broadcast; its size is fixed.
    """
    results = ("tokens", "n_tokens", "decoded_ok")
    if clash := {k.lower() for k in keep} & {*results}:
        raise ValueError(f"kept columns are called like results: {clash}")
    spark = df.sparkSession
    tokens = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((tokens, split_table(tokens)))
    key = (vocabulary, pattern)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "tokens array<int>, n_tokens int, decoded_ok boolean"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)
        decoder = Decoder(encoder.tokens)
        for b in text_slices(batches, "__text", SLICE):
            col = b.column(b.num_columns - 1)
            null = np.asarray(col.is_null())
            texts = col.fill_null("")
            ids, offsets = encoder.encode_batch(texts.to_pylist())
            data, ends = decoder.decode_batch(ids, offsets)
            raw, raw_ends = string_buffers(texts)
            same_size = np.diff(ends) == np.diff(raw_ends)
            if same_size.all():
                wrong = np.flatnonzero(data != raw)
                ok = np.ones(len(texts), bool)
                ok[np.searchsorted(raw_ends, wrong, "right") - 1] = False
            else:
                ok = np.array([bytes(data[ends[k] : ends[k + 1]]) == bytes(raw[raw_ends[k] : raw_ends[k + 1]]) for k in range(len(texts))])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            if null.any():
                lists = lists.take(pa.array(np.arange(len(null)), mask=null))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(np.diff(offsets).astype(np.int32), mask=null), pa.array(ok, mask=null)], [*keep, *results])
        encoder._forget()  # workers live on

    return df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, *, tokens_col: str = "tokens", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and `text`, decoded from the token lists; null for null. Ids outside the vocabulary fail."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "text string"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lists = part.column(part.num_columns - 1)
                null = np.asarray(lists.is_null())
                sizes = np.where(null, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                data, ends = decoder.decode_batch(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
                raw = data.tobytes()
                texts = [None if null[k] else raw[ends[k] : ends[k + 1]].decode("utf-8") for k in range(len(sizes))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*[F.col(c) for c in keep], F.col(tokens_col).alias("__tokens")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY, ORACLE = ("op3_byte_bpe", query), None
