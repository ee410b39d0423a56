"""Exact k nearest neighbours with KD-trees per shard.

A router, median splits over a bounded sample of vectors, sends each vector to a cell; a cell with more rows than a
shard should have is cut into several shards by a hash. Each shard builds a KD-tree: median splits along the widest
side, tight bounding boxes at every node. A query first searches the shard where it would lie itself, best first: nodes
wait in a queue by their box's distance to the query, and the search of a block of queries ends when no waiting box is
nearer than the k-th neighbour found. That k-th distance goes along with the query: a tree over the shards' tight boxes
finds those other shards that may hold something nearer, it is sent to them alone, and bounds the search there from the
start. The best k of all shards are the exact answer; the router decides about speed only. Where vectors lie so that
boxes tell nothing (independent coordinates in many dimensions), each query visits each shard, in blocks.

A shard's rows and a block's queries are bounded, so no task holds more than one of each; a shard with many queries is
given to several tasks.

Distances are Euclidean over float64. Defined results: neighbours are ordered by distance, then id; ids may have any
type that can be sorted; a vector isn't its own neighbour, though rows that repeat a vector are (of rows with one id,
one counts: the least vector; a null id is no neighbour and no query); null vectors, vectors with a null or NaN element
and those of another length than most rows are left out; vectors may be long, a row is held whole; with fewer than k
others, all of them are given; an empty table gives an empty result; other columns, by any name, are passed over.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialise, partitions_for

K = 10
LEAF = 256
ROWS_PER_SHARD = 16_384
#: queries that a task takes with one shard at most
QUERIES_PER_BLOCK = 32_768
#: the shards' boxes, which all tasks hold, have at most so many bytes; beyond that shards get larger instead of more
BOX_BYTES = 64 << 20
#: vectors that fit the router; they decide about speed only
ROUTER_ROWS = 20_000
#: queries are the rows whose id is divisible by this
EVERY = 20
_GROUP = 256
#: what rounding may take from a box's distance
_SLACK = 1 - 1e-12


class Tree:
    """KD-tree over the rows of `x`; nodes in arrays, leaves are ranges of `order`."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        self.low, self.high, self.kids, self.range = [], [], [], []
        if len(x):
            self._build(0, len(x), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.x = x[self.order]
        self.norm = np.einsum("ij,ij->i", self.x, self.x)

    def _build(self, a: int, b: int, leaf: int) -> int:
        rows = self.x[self.order[a:b]]
        low, high = rows.min(0), rows.max(0)
        me = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(())
        self.range.append((a, b))
        axis = int((high - low).argmax())
        if b - a > leaf and high[axis] > low[axis]:
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
            self.kids[me] = (self._build(a, a + mid, leaf), self._build(a + mid, b, leaf))
        return me

    def leaves(self) -> list[tuple[int, int]]:
        return [r for r, k in zip(self.range, self.kids) if not k]

    def bounds(self, node: int, q: np.ndarray) -> np.ndarray:
        """Squared distances from queries to a node's box."""
        return _box_distance(self.low[node], self.high[node], q)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances) of up to k rows for each query nearer than, or as near as, `kth`; inf where none.

        Places are those in the `x` given; `own` is each query's own place there, or -1. Ties at a distance go to
        smaller places.
        """
        n = len(q)
        best_d = np.full((n, k), np.inf)
        best_i = np.full((n, k), len(self.x))
        limit = kth.copy()
        if not len(self.x):
            return best_i, best_d
        queue = [((first := self.bounds(0, q)).min(), 0, 0, first)]
        count = 1
        qn = np.einsum("ij,ij->i", q, q)
        while queue:
            nearest, _, node, bound = heapq.heappop(queue)
            if nearest * _SLACK > limit.max():
                break
            live = np.flatnonzero(bound * _SLACK <= limit)
            if not len(live):
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    b = self.bounds(kid, q)
                    heapq.heappush(queue, (b.min(), count, kid, b))
                    count += 1
                continue
            a, b = self.range[node]
            ql = q[live]
            rough = qn[live, None] + self.norm[None, a:b] - 2 * (ql @ self.x[a:b].T)
            slack = 1e-9 * (qn[live, None] + self.norm[None, a:b]) + 1e-12
            hit, col = np.nonzero((rough - slack <= limit[live, None]) & (self.order[None, a:b] != own[live, None]))
            if not len(hit):
                continue
            diff = ql[hit] - self.x[a + col]
            exact = (diff * diff).sum(1)
            good = exact <= limit[live][hit]
            if good.any():
                row = live[hit[good]]
                _keep_best(best_d, best_i, row, exact[good], self.order[a + col[good]])
                limit = np.minimum(limit, best_d[:, -1])
        return best_i, best_d


def _box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = np.maximum(low - q, 0) + np.maximum(q - high, 0)
    return np.einsum("ij,ij->i", d, d)


def _keep_best(best_d: np.ndarray, best_i: np.ndarray, row: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
    """Put candidates (row, distance, place) among the best of their rows."""
    k = best_d.shape[1]
    rows = np.unique(row)
    all_row = np.concatenate([np.repeat(rows, k), row])
    all_d, all_i = np.concatenate([best_d[rows].ravel(), d]), np.concatenate([best_i[rows].ravel(), i])
    order = np.lexsort((all_i, all_d, all_row))
    first = np.searchsorted(all_row[order], rows)
    top = order[(first[:, None] + np.arange(k)).ravel()]
    best_d[rows], best_i[rows] = all_d[top].reshape(-1, k), all_i[top].reshape(-1, k)


class BoxTree:
    """Binary tree over the boxes of shards, neighbours in the given order together; finds the boxes near to queries."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.levels = [(low, high)]
        while len(low) > 1:
            at = np.arange(0, len(low), 2)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((low, high))

    def near(self, q: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, box) of all pairs whose distance is `kth` of the query or less."""
        row, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for depth, (low, high) in enumerate(reversed(self.levels)):
            if depth:
                row, node = np.repeat(row, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
                row, node = row[node < len(low)], node[node < len(low)]
            on = _box_distance(low[node], high[node], q[row]) * _SLACK <= kth[row]
            row, node = row[on], node[on]
        return row, node


def fit_router(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Median splits (axis, value) of a complete binary tree with `cells` leaves, in heap order."""
    splits: list[tuple[int, float]] = [(0, 0.0)] * (cells - 1)

    def cut(node: int, rows: np.ndarray) -> None:
        if node >= cells - 1:
            return
        if len(rows):
            axis = int(rows.var(0).argmax())
            value = float(np.median(rows[:, axis]))
            splits[node] = (axis, value)
            below = rows[:, axis] < value
            cut(2 * node + 1, rows[below])
            cut(2 * node + 2, rows[~below])

    cut(0, sample)
    return splits


def route(x: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    inner = len(splits)
    if inner:
        axis, value = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        while (node < inner).any():
            on = np.flatnonzero(node < inner)
            n = node[on]
            node[on] = 2 * n + 1 + (x[on, axis[n]] >= value[n])
    return node - inner


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int | None = None) -> tuple[DataFrame, int]:
    """(id, vec), one row for each id, and the vectors' length: `dims` or that of most rows."""
    kind = df.schema[vec_col].dataType
    exact = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # a float is half the size
    own = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if exact else "array<double>").alias("vec"))
    own = own.where("id is not null and vec is not null and not exists(vec, e -> e is null or isnan(e)) and size(vec) > 0")
    if dims is None:
        most = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dims = most[0] if most else 0
    return own.where(F.size("vec") == dims).groupBy("id").agg(F.min("vec").alias("vec")), dims


def nearest(df: DataFrame, queries: DataFrame | None = None, *, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", rows_per_shard: int = ROWS_PER_SHARD, queries_per_block: int = QUERIES_PER_BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank (from 1), neighbour_id and distance of the k nearest vectors of `df` to each of `queries` (by
    default, to each of its own) that have another id."""
    spark = df.sparkSession
    rows, dims = clean_vectors(df, id_col, vec_col)
    rows = materialise(rows, "vectors")
    total = rows.count()
    asked = rows if queries is None else materialise(clean_vectors(queries, id_col, vec_col, dims)[0], "queries")
    rows_per_shard = max(rows_per_shard, 2 * total * 16 * max(dims, 1) // BOX_BYTES)
    cells = 1
    while cells * rows_per_shard < total:
        cells *= 2
    splits: list[tuple[int, float]] = []
    if cells > 1:
        bound = min(1.0, ROUTER_ROWS / total)
        taken = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(bound * (1 << 30))).select("vec").toArrow()
        splits = fit_router(np.array(taken["vec"].to_pylist(), np.float64).reshape(-1, dims), cells)
    id_type, vec_type = (rows.schema[c].dataType.simpleString() for c in ("id", "vec"))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route(_matrix(b.column(1)), splits))], ["id", "vec", "cell"])

    celled, asked_cells = (t.mapInArrow(to_cells, f"id {id_type}, vec {vec_type}, cell long") for t in (rows, asked))
    # a row for each cell; the cells' number is bounded by BOX_BYTES
    sizes = F.broadcast(materialise(celled.groupBy("cell").count().select(F.col("cell").alias("c"), F.ceil(F.col("count") / rows_per_shard).cast("int").alias("parts")), "cells"))
    shard = F.struct("cell", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    in_shard = lambda t: t.join(sizes, F.col("cell") == F.col("c"), "left").select("id", "vec", shard.alias("s")).select("id", "vec", "s.cell", "s.part")
    sharded = materialise(in_shard(celled), "shards")

    results = f"query_id {id_type}, neighbour_id {id_type}, d2 double"

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, x, q = rows["id"].combine_chunks(), _matrix(rows["vec"].combine_chunks()), _matrix(asked["vec"].combine_chunks())
        q_ids = asked["id"].combine_chunks()
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(x) and len(q):
            tree = Tree(x, leaf)
            own = pc.index_in(q_ids, value_set=ids).fill_null(-1).to_numpy()
            kth = asked["kth"].to_numpy()
            order = Tree(q, _GROUP).order  # neighbours go together
            for a in range(0, len(q), _GROUP):
                some = order[a : a + _GROUP]
                i, d = tree.search(q[some], own[some], k, kth[some])
                found = np.isfinite(d)
                out.append((np.repeat(some, found.sum(1)), i[found], d[found]))
        which, i, d = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": q_ids.take(pa.array(which)), "neighbour_id": ids.take(pa.array(i)), "d2": d})

    def searched(asked: DataFrame, name: str) -> DataFrame:
        """Results of (id, vec, cell, part, kth) against the rows of their shards, a block of queries at a time."""
        many = asked.groupBy("cell", "part").count().select(F.col("cell").alias("c"), F.col("part").alias("p"), F.ceil(F.col("count") / queries_per_block).cast("int").alias("blocks"))
        many = F.broadcast(materialise(many, "blocks"))  # as many rows as there are boxes
        here = (F.col("cell") == F.col("c")) & (F.col("part") == F.col("p"))
        cut = asked.join(many, here).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("c", "p", "blocks")
        copies = sharded.join(many, here).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("c", "p", "blocks")
        by = ["cell", "part", "block"]
        return materialise(cut.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(search, results), name)

    never = F.lit(float("inf"))
    at_home = in_shard(asked_cells).withColumn("kth", never)
    if cells > 1:
        at_home = materialise(at_home, "at-home")
    home = searched(at_home, "home")
    if cells == 1:
        merged = home
    else:
        # the tight box of each shard: a row for each shard, fewer by the shard size than the vectors
        def box(t: pa.Table) -> pa.Table:
            x = _matrix(t["vec"].combine_chunks())
            return pa.table({"cell": t["cell"].slice(0, 1), "part": t["part"].slice(0, 1), "low": [x.min(0)], "high": [x.max(0)]})
        corner = materialise(sharded.groupBy("cell", "part").applyInArrow(box, "cell long, part int, low array<double>, high array<double>"), "boxes").orderBy("cell", "part").toArrow()
        cell, part = corner["cell"].to_numpy(), corner["part"].to_numpy()
        low, high = (np.array(corner[c].to_pylist(), np.float64).reshape(len(cell), dims) for c in ("low", "high"))
        shared = spark.sparkContext.broadcast((cell, part, BoxTree(low, high)))
        kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("d2")).otherwise(never).alias("k2"))
        bounded = at_home.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "vec", "cell", "part", F.coalesce("k2", never).alias("kth"))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, part, tree = shared.value
            step = max(1, (4 << 20) // (len(cell) * dims))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    row, box = tree.near(_matrix(b.column(1)), b.column(4).to_numpy())
                    away = (cell[box] != b.column(2).to_numpy()[row]) | (part[box] != b.column(3).to_numpy()[row])
                    take, box = pa.array(row[away]), box[away]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell[box]), pa.array(part[box]), b.column(4).take(take)], ["id", "vec", "cell", "part", "kth"])

        sent = materialise(bounded.mapInArrow(send, f"id {id_type}, vec {vec_type}, cell long, part int, kth double"), "sent")
        merged = home.union(searched(sent, "away"))
    w = Window.partitionBy("query_id").orderBy("d2", "neighbour_id")
    top = merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "neighbour_id", F.sqrt("d2").alias("distance"))


def query(spark, sf_dir: str) -> DataFrame:
    """The K nearest embeddings of every embedding whose id is divisible by EVERY, among all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
    return out.withColumn("distance", F.round("distance", 6))


ORACLE = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
       FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbour_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= {K}"""
QUERY = ("op5_exact_knn", query)
