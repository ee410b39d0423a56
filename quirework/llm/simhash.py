"""Near-duplicate groups by SimHash, a positional inverted index and count filtering.

A document's fingerprint has 128 bits: bit by bit the sign of the sum of its distinct folded words' hash bits, a word
that occurs c times weighing log2(1 + c). Its first 126 bits are 7 blocks of 6 units of 3 bits. Two fingerprints within
20 bits differ in at most 2 bits of one block at least (7 blocks of 3 would be 21), and so share at least 4 of its 6
units at the same positions: the guaranteed minimum. The inverted index lists fingerprints under every four positional
units of a block (15 for each block), so that every pair within 20 bits meets; pairs that meet are verified by the
distance over all 128 bits, and a near one is taken in the list of its first four shared units alone. In long lists the
members without a near one are sorted out first, and the others are walked from member to member over those not reached
yet, which gives the same groups without writing every pair. The pairs that meet grow with the square of the number of
fingerprints, as keys that give the guarantee are short.

Groups are the connected components of verified pairs. Exact copies have one fingerprint and enter the index once.

Defined results: a document without words (null, empty, only punctuation) is in no group; texts are used whole; equal
texts are always in one group, rows that repeat an id too; of each group the row with the smallest id stays (a null id
comes last), of rows with equal id and text one; an empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bitmap_words, likely, materialise, partitions_for, text_slices, trimmed, unit_hash
from ._hashing import mix, string_buffers, word_hashes

BLOCKS, UNITS, UNIT_BITS = 7, 6, 3
#: a pair is near at this distance of 128 bits or less
MAX_DISTANCE = 20
#: units of one block at least that near fingerprints share
MIN_SHARED = UNITS - MAX_DISTANCE // BLOCKS
#: a worker takes about 100 bytes a posting while it compares a partition
POSTINGS_PER_PARTITION = 500_000
_COMBOS = np.array(list(combinations(range(UNITS), MIN_SHARED)))
_KEY_BITS = MIN_SHARED * UNIT_BITS
_SEEDS = (np.uint64(0x5157), np.uint64(0x9E3779B97F4A7C15))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
#: mask of shared units -> which of the combinations holds its first four (or 255)
_FIRST = np.full(1 << UNITS, 255, np.uint8)
for _m in range(1 << UNITS):
    _on = [i for i in range(UNITS) if _m >> i & 1]
    if len(_on) >= MIN_SHARED:
        _FIRST[_m] = int(np.flatnonzero((_COMBOS == _on[:MIN_SHARED]).all(1))[0])
_SMALL_LIST = 48


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((rows, 2) uint64 fingerprints, number of words) of texts."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 16), np.uint8)
    h, first = word_hashes(data, offsets)
    words = np.diff(first)
    if len(h):
        row = np.repeat(np.arange(rows), words)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        weight = np.log2(1 + np.diff(np.append(at, len(h)))).astype(np.float32)
        h, row = h[at], row[at]
        start = np.searchsorted(row, np.arange(rows + 1))
        k = 0
        while k < rows:  # some rows at a time, so that the bit sums stay in the cache
            to = min(max(int(np.searchsorted(start, start[k] + 8192, "right")) - 1, k + 1), rows)
            a, b = start[k], start[to]
            some = np.flatnonzero(np.diff(start[k : to + 1]))
            if len(some):
                sums, total = _bit_sums(h[a:b], weight[a:b], start[k:to][some] - a)
                out[k + some] = np.packbits(2 * sums > total[:, None], axis=1)
            k = to
    return out.view(np.uint64).reshape(rows, 2), words


def _bit_sums(h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.stack([mix(h + s) for s in _SEEDS], axis=1)
    bits = _BITS[hashes.view(np.uint8)].reshape(len(h), 128)
    bits *= weight[:, None]
    return np.add.reduceat(bits, starts, axis=0), np.add.reduceat(weight, starts)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _units(fp: np.ndarray) -> np.ndarray:
    """(rows, BLOCKS, UNITS) values of the units."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 16), axis=1)
    bits = bits[:, : BLOCKS * UNITS * UNIT_BITS].reshape(len(fp), BLOCKS, UNITS, UNIT_BITS)
    return bits @ (1 << np.arange(UNIT_BITS))


def first_column(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first column of `posting_keys` in which two arrays of fingerprints agree, row by row."""
    mask = (_units(x ^ y) == 0) @ (1 << np.arange(UNITS))
    first = _FIRST[mask]
    block = (first != 255).argmax(axis=1)
    return block * len(_COMBOS) + first[np.arange(len(x)), block]


def posting_keys(fp: np.ndarray) -> np.ndarray:
    """(rows, 105) int64 keys: block and combination (the column), the four units."""
    four = _units(fp)[:, :, _COMBOS]  # rows, 7, 15, 4
    key = (four @ (1 << UNIT_BITS * np.arange(MIN_SHARED))).reshape(len(fp), -1)
    return key + (np.arange(key.shape[1]) << _KEY_BITS)


def _with_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of fingerprints (halves a and b) that have another near one among them."""
    n = len(a)
    found = np.zeros(n, bool)
    step = max(1, (1 << 17) // n)
    for i in range(0, n, step):
        near = np.bitwise_count(a[i : i + step, None] ^ a[i:]) + np.bitwise_count(b[i : i + step, None] ^ b[i:]) <= MAX_DISTANCE
        own = np.arange(len(near))
        near[own, own] = False
        found[i : i + step] |= near.any(1)
        found[i:] |= near.any(0)
    return np.flatnonzero(found)


def list_edges(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near fingerprints that share a key; enough of them to connect all that are near."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    a, b = np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1])
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    xs, ys = [], []
    small = np.repeat((size > 1) & (size <= _SMALL_LIST), size)
    at = np.flatnonzero(small)
    for d in range(1, _SMALL_LIST):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        near = np.bitwise_count(a[at] ^ a[at + d]) + np.bitwise_count(b[at] ^ b[at + d]) <= MAX_DISTANCE
        x = at[near]
        x = x[first_column(fp[x], fp[x + d]) == key[x] >> _KEY_BITS]
        xs.append(x)
        ys.append(x + d)
    for s, n in zip(start[size > _SMALL_LIST], size[size > _SMALL_LIST]):
        left = s + _with_near(a[s : s + n], b[s : s + n])
        while len(left):
            stack, left = [left[0]], left[1:]
            while stack and len(left):
                x = stack.pop()
                near = distance(fp[left], fp[x]) <= MAX_DISTANCE
                reached = left[near]
                if len(reached):
                    xs.append(np.full(len(reached), x))
                    ys.append(reached)
                    stack += list(reached)
                    left = left[~near]
    cat = lambda a: order[np.concatenate(a)] if a else np.zeros(0, np.int64)
    return cat(xs), cat(ys)


def _binary16(fp: np.ndarray) -> pa.Array:
    n = len(fp)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(fp).tobytes())])


def document_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, unit (a hash of the text) and fp (16 bytes, null without words) of every row."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            fp, words = fingerprints(*string_buffers(b.column(2)))
            arr = _binary16(fp)
            if (words == 0).any():
                arr = arr.take(pa.array(np.arange(len(words)), mask=words == 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), arr], ["id", "unit", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), unit_hash(text_col).alias("unit"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, unit string, fp binary")


def near_edges(nodes: DataFrame, count: int) -> DataFrame:
    """Edges (u, v) between near fingerprints among the distinct `nodes.fp`."""

    @trimmed
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                data, offs = string_buffers(b.column(0).slice(at, 1024))
                fp = np.ascontiguousarray(data).view(np.uint64).reshape(-1, 2)
                keys = posting_keys(fp)
                many = keys.shape[1]
                signed = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(signed[:, 0], many)), pa.array(np.repeat(signed[:, 1], many))], ["k", "a", "b"])

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], []]
        for b in batches:
            for c, own in zip(b.columns, cols):
                own.append(c.to_numpy())
        if not cols[0]:
            return
        key = np.concatenate(cols[0])
        fp = np.stack([np.concatenate(c) for c in cols[1:]], axis=1).view(np.uint64)
        del cols
        x, y = list_edges(key, fp)
        for at in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([_binary16(fp[x[at : at + (1 << 16)]]), _binary16(fp[y[at : at + (1 << 16)]])], ["u", "v"])

    parts = partitions_for(count * BLOCKS * len(_COMBOS), POSTINGS_PER_PARTITION)
    postings = nodes.select("fp").mapInArrow(post, "k long, a long, b long").repartition(parts, "k")
    return postings.mapInArrow(meet, "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, root the smallest of its component: large-star and small-star in turn
    until the edges stand still."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = state(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "edges")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def rooted(rows: DataFrame) -> DataFrame:
    """`rows` (with fp) and root, the same for all whose fingerprints are connected by near ones."""
    nodes = materialise(rows.select("fp").distinct(), "nodes")
    roots = materialise(components(near_edges(nodes, nodes.count())), "roots")
    return rows.join(roots, rows.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node", "fp")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row in a group of two or more: id, unit, group_id (the id of the row that stays), group_size, kept."""
    rows = materialise(document_fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    grouped = rooted(rows.where("fp is not null"))
    size = grouped.groupBy("root").agg(F.count("*").alias("group_size")).where("group_size > 1")
    w = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "unit")
    return (
        grouped.join(size, "root")
        .withColumn("place", F.row_number().over(w))
        .withColumn("group_id", F.first("id").over(w))
        .select("id", "unit", "group_id", "group_size", (F.col("place") == 1).alias("kept"))
    )


@F.pandas_udf(T.BooleanType())
def _is_rest(part: pd.Series, whole: pd.Series) -> pd.Series:
    """Whether the words of a text follow one another, others between them, in another text."""
    out = []
    for p, w in zip(part, whole):
        words = iter((w or "").split())
        out.append(all(any(x == y for y in words) for x in (p or "").split()))
    return pd.Series(out, dtype=bool)


def drop_copies_before_edit(docs: DataFrame, before: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without all but one of each group of near copies that their texts in `before`,
    a table from which `docs` come by leaving words out, make.

    A document takes part whose id isn't null and stands once in each table, and whose text is what is left of that in
    `before`; others stay. Of a group the smallest id stays.
    """
    id_ = F.col(id_col)
    once = lambda df: df.where(id_.isNotNull()).groupBy(id_.alias("o")).agg(F.count("*").alias("n")).where("n = 1").select("o")
    rows = document_fingerprints(before, id_col=id_col, text_col=text_col).where("fp is not null")
    rows = rows.join(once(docs), rows.id == F.col("o"), "left_semi").join(once(before), rows.id == F.col("o"), "left_semi")
    grouped = rooted(materialise(rows.select("id", "fp"), "fingerprints"))
    size = grouped.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    members = materialise(grouped.join(size, "root").select("id", "root"), "members")
    hashes = lambda k: (F.xxhash64(k), F.xxhash64(F.lit(1), k))

    def among(df: DataFrame, ids: DataFrame) -> DataFrame:
        k, k2 = hashes(F.col("id"))
        return likely(df, ids.select(k.alias("k"), k2.alias("k2")), hashes(id_), bitmap_words(ids.count()))

    texts = [among(df, members).where("__qw_likely").select(id_.alias("id"), F.col(text_col).alias(name)) for df, name in ((before, "whole"), (docs, "part"))]
    sure = members.join(texts[0], "id").join(texts[1], "id").where(_is_rest("part", "whole")).select("id", "root")
    sure = materialise(sure, "sure")
    stays = sure.groupBy("root").agg(F.min("id").alias("first"))
    gone = materialise(sure.join(stays, "root").where("id > first").select("id"), "gone")
    marked = among(docs, gone)
    some = marked.where("__qw_likely").drop("__qw_likely")
    return marked.where("not __qw_likely").select(docs.columns).unionByName(some.join(gone.select(F.col("id").alias("__qw_gone")), id_ == F.col("__qw_gone"), "left_anti").select(docs.columns))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without all but one of each group."""
    found = groups(docs, id_col=id_col, text_col=text_col)
    units = materialise(found.groupBy("id", "unit").agg(F.max("kept").alias("kept"), F.count("*").alias("many")), "units")
    unit = "__qw_unit"
    keyed = docs.withColumn(unit, unit_hash(text_col))
    same = keyed[id_col].eqNullSafe(units.id) & (keyed[unit] == units.unit)
    out = keyed.join(units.where("not kept or many > 1"), same, "left_anti").select(docs.columns)
    again = units.where("kept and many > 1")
    if not again.isEmpty():  # rows that repeat an id and a text and stay: one of them
        one = keyed.join(again, same, "left_semi").dropDuplicates([id_col, unit]).select(docs.columns)
        out = out.union(one)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """All documents that have exact or near copies, with their groups."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "group_id", "group_size", "kept")


QUERY, ORACLE = ("op8_simhash_near_dedup", query), None
