"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. An n-gram is bound from the permuted (rotated) vectors of its letters by
elementwise product; a text is the bundle (sum) of its n-grams; a language's prototype is the bundle of its labelled
training texts. A document gets the language whose prototype has the largest cosine with the document's vector.

Letters are folded UTF-8 bytes: ASCII letters and Latin-1 capitals are lower-cased, every run of other ASCII bytes is
one space, bytes above 127 count as letters of their own, so that any script has letters.

Defined results: a null or empty text, or one without letters, has no language (null), cosine 0 and is rejected; texts
are used whole, however long; equal cosines go to the first language by name; repeated rows get the same result each;
without any labelled training row every document is rejected; an empty table gives an empty result; other columns of
the input, by any name, are passed over by `identify` and kept by `keep_accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_slices, trimmed
from ._hashing import string_buffers

RESULT = "{id} {id_type}, language string, cosine double, margin double, accepted boolean"

_FOLD = np.full(256, 0, np.uint8)
for _c in range(26):
    _FOLD[97 + _c] = _FOLD[65 + _c] = 1 + _c
_FOLD[128:] = np.arange(27, 155)
LETTERS = 155
#: bytes of text that are made vectors at a time: a worker's memory follows it
SLICE = 1 << 20
_SPACE = 0


@dataclass(frozen=True)
class Settings:
    """`dims`: length of the vectors; `n`: letters in an n-gram; `min_cosine`: below it a document is rejected, whatever
    its length (three times the spread of the cosine of vectors that have nothing in common); `train_rows`: about as many labelled rows at most are used for the prototypes, an equal share for each language (chosen by a hash of the id)."""

    dims: int = 1024
    n: int = 3
    min_cosine: float = 0.1
    train_rows: int = 20_000
    seed: int = 20


@dataclass
class Profiles:
    settings: Settings
    languages: list[str] = field(default_factory=list)
    prototypes: np.ndarray | None = None  # (languages, dims), unit length


def letter_vectors(s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).integers(0, 2, (LETTERS, s.dims), np.int8) * np.int8(2) - np.int8(1)


def ngram_vectors(codes: np.ndarray, s: Settings) -> np.ndarray:
    """int8 vectors of n-gram codes: the letter at place i is rotated by n - 1 - i places."""
    letters = letter_vectors(s)
    out, rest = None, codes
    for shift in range(s.n):
        rest, letter = np.divmod(rest, LETTERS)
        v = np.roll(letters, shift, axis=1)[letter]
        out = v if out is None else np.multiply(out, v, out=out)
    return out


def ngram_codes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row) of all letter n-grams; each text has a space before and after it, and runs of spaces are one."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    at = offsets[:-1] + 2 * np.arange(rows)  # where each text starts when two spaces stand around each
    letters = np.zeros(len(data) + 2 * rows, np.uint8)
    row = np.repeat(np.arange(rows, dtype=np.int32), sizes + 2)
    keep = np.ones(len(letters), bool)
    keep[at] = False
    keep[at + sizes + 1] = False
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    letters[keep] = _FOLD[np.where(capital, data + np.uint8(32), data)]
    same = np.ones(len(letters), bool)  # drop a space after a space of the same row
    same[1:] = (letters[1:] != _SPACE) | (letters[:-1] != _SPACE) | (row[1:] != row[:-1])
    letters, row = letters[same], row[same]
    if len(letters) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    m = len(letters) - n + 1
    codes = np.zeros(m, np.int64)
    for i in range(n):
        codes = codes * LETTERS + letters[i : i + m]
    whole = row[:m] == row[n - 1 :]
    return codes[whole], row[:m][whole]


def text_vectors(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dims) float32, the bundles of the n-grams of each text, and the number of its n-grams."""
    rows = len(offsets) - 1
    out = np.zeros((rows, s.dims), np.float32)
    codes, row = ngram_codes(data, offsets, s.n)
    many_ngrams = np.bincount(row, minlength=rows)
    if not len(codes):
        return out, many_ngrams
    distinct, code = np.unique(codes, return_inverse=True)
    step_cols = 8192
    bounds = np.searchsorted(row, np.arange(0, rows + 256, 256))
    for c in range(0, len(distinct), step_cols):
        vectors = ngram_vectors(distinct[c : c + step_cols], s).astype(np.float32)
        width = len(vectors)
        for k in range(len(bounds) - 1):
            a, b = bounds[k], bounds[k + 1]
            if a == b:
                continue
            first, cc = k * 256, code[a:b] - c
            rr = row[a:b] - first
            if len(distinct) > step_cols:
                inside = (cc >= 0) & (cc < width)
                cc, rr = cc[inside], rr[inside]
            many = min(256, rows - first)
            counts = np.bincount(rr.astype(np.int64) * width + cc, minlength=many * width).astype(np.float32)
            out[first : first + many] += counts.reshape(many, width) @ vectors
    return out, many_ngrams


def train(docs: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int | None = None) -> Profiles:
    """Prototypes from about `settings.train_rows` labelled rows at most, the same share for each language: all rows of
    a language with no more than its share, else those with the smallest hashes of their ids.

    Only the n-gram counts of each language reach the driver; their number doesn't grow with the input.
    """
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")
    if rows is None or rows > settings.train_rows:
        labelled = {r.l: r.n for r in narrow.groupBy("l").agg(F.count("*").alias("n")).collect()}
        share = max(1, settings.train_rows // max(1, len(labelled)))
        hashed = F.pmod(F.xxhash64("i"), F.lit(1 << 30))
        for lang, many in labelled.items():
            if many > share:
                narrow = narrow.where((F.col("l") != lang) | (hashed < int(share / many * (1 << 30))))
    n = settings.n

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in text_slices(batches, "t", SLICE):
            codes, row = ngram_codes(*string_buffers(b.column(0)), n)
            names, index = np.unique(np.array(b.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for k, name in enumerate(names):
                if name not in totals:
                    totals[name] = np.zeros(LETTERS**n, np.int64)
                got, c = np.unique(codes[index[row] == k], return_counts=True)
                totals[name][got] += c
        for name, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(t[at])], ["l", "code", "c"])

    counted = narrow.select("t", "l").mapInArrow(count, "l string, code long, c long")
    table = counted.groupBy("l", "code").agg(F.sum("c").alias("c")).toArrow()
    profiles = Profiles(settings)
    if table.num_rows == 0:
        return profiles
    lang = np.array(table["l"].to_pylist(), object)
    code, c = table["code"].to_numpy(), table["c"].to_numpy()
    profiles.languages = sorted(set(lang))
    vectors = []
    for name in profiles.languages:
        own = lang == name
        v = np.zeros(settings.dims)
        for a in range(0, own.sum(), 4096):
            v += c[own][a : a + 4096].astype(np.float64) @ ngram_vectors(code[own][a : a + 4096], settings).astype(np.float64)
        vectors.append(v)
    p = np.array(vectors)
    norm = np.linalg.norm(p, axis=1, keepdims=True)
    profiles.prototypes = p / np.where(norm == 0, 1, norm)
    return profiles


def classify(texts: pa.Array, profiles: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language or -1, cosine, margin over the next language, accepted) of each text."""
    n = len(texts)
    if profiles.prototypes is None:
        return np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    v, _ = text_vectors(*string_buffers(texts), profiles.settings)
    v = v.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    cosines = v @ profiles.prototypes.T / np.where(length == 0, 1, length)[:, None]
    best = cosines.argmax(1)
    top = cosines[np.arange(n), best]
    others = np.sort(cosines, axis=1)
    margin = top - (others[:, -2] if others.shape[1] > 1 else 0)
    empty = length == 0
    best = np.where(empty, -1, best)
    return best, np.where(empty, 0, top), np.where(empty, 0, margin), ~empty & (top >= profiles.settings.min_cosine)


def identify(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: its id, language, cosine, margin over the next language, accepted."""
    schema = RESULT.format(id=f"`{id_col}`", id_type=dict(docs.select(id_col).dtypes)[id_col])
    languages = profiles.languages

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t", SLICE):
            best, cosine, margin, ok = classify(b.column(1), profiles)
            names = pa.array([languages[k] if k >= 0 else None for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), names, pa.array(cosine), pa.array(margin), pa.array(ok)], [id_col, "language", "cosine", "margin", "accepted"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def keep_accepted(docs: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose language is recognised."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text_col, SLICE):
            yield b.filter(pa.array(classify(b.column(b.schema.get_field_index(text_col)), profiles)[3]))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


QUERY, ORACLE = ("op1_language_id", query), None
