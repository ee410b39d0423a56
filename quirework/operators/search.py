"""Search in lines: keyword in context, match counts, and ranking of similar words by skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_W, _N = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_MARKS = "\ufdd0\ufdd1\ufdd2\ufdd3"  # noncharacters: they stand in no text


def term_pattern(term: str) -> str:
    """A term with * at its start or end as a pattern; the rest of it is a pattern already."""
    if term.startswith("*"):
        term = f"{_W}*" + term[1:]
    if term.endswith("*"):
        term = term[:-1] + f"{_W}*"
    return term


def keyword_in_context(lines: DataFrame, term: str, *, text: str = "text", keys: list[str] = [], context: int = 3, ignorecase: bool = True, max_hits: int = -1) -> DataFrame:
    """`keys`, term, term_match, hit (from 1, in the line), match_offset (from 0), pre, post and context of each match.

    Matches with their context words don't overlap. `max_hits` limits the result; which matches it keeps is open.
    The line is searched once: the pattern puts marks (characters that no text may hold) around the parts of each match.
    """
    case = "(?i)" if ignorecase else ""
    # a match begins with a whole word, so the words before the term are tried from the starts of words only
    before, after = f"(?:(?<!{_W})(?:{_W}++{_N}++){{1,{context}}})?", f"(?:{_N}++{_W}++){{0,{context}}}"
    pattern = f"{case}(?U)(?<pre>{before})\\b(?<main>{term_pattern(term)})\\b(?<post>{after})"
    cheap = F.col(text).rlike(case + term_pattern(term))  # most lines end here
    marked = F.regexp_replace(F.translate(F.col(text), _MARKS, " " * len(_MARKS)), pattern, "{}${{pre}}{}${{main}}{}${{post}}{}".format(*_MARKS))
    found = lines.where(cheap).select(*keys, F.split(marked, _MARKS[0], -1).alias("__p")).where(F.size("__p") > 1)
    hits = found.select(*keys, F.transform("__p", lambda p: F.length(p)).alias("__n"), F.posexplode("__p").alias("hit", "__m")).where("hit > 0")
    # each match has three marks in its piece beside the one that it was split at
    offset = F.aggregate(F.slice("__n", F.lit(1), F.col("hit")), F.lit(0), lambda s, n: s + n) - 3 * (F.col("hit") - 1)
    part = lambda i: F.split("__m", f"[{_MARKS[1:]}]", -1)[i]
    out = hits.select(*keys, F.lit(term).alias("term"), "hit", offset.alias("match_offset"), part(0).alias("pre"), part(1).alias("term_match"), part(2).alias("post"))
    pre = F.col("pre")
    whole = F.concat(F.when(F.length(pre) < context * 10, F.lpad(pre, context * 10, " ")).otherwise(pre), "term_match", "post")
    out = out.select(*keys, "term", "term_match", "hit", "match_offset", "pre", "post", whole.alias("context"))
    return out if max_hits < 0 else out.limit(max_hits)


def match_frequency(hits: DataFrame) -> DataFrame:
    return hits.groupBy("term_match").agg(F.count("*").alias("freq"))


def skipgrams(word: Column, n: int = 2, skip: int = 1) -> Column:
    """Distinct skip-grams of two letters, up to `skip` letters between them, of a word with # before and after it."""
    if n != 2:
        raise ValueError("skip-grams have two letters")
    w = F.concat(F.lit("#"), F.lower(word), F.lit("#"))
    grams = [_grams_at(w, d) for d in range(1, skip + 2)]
    return F.array_distinct(F.concat(*grams))


def _grams_at(w: Column, distance: int) -> Column:
    none = F.array().cast("array<string>")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - distance, F.lit(1))), lambda i: F.concat(F.substring(w, i, F.lit(1)), F.substring(w, i + distance, F.lit(1))))
    return F.when(F.length(w) > distance, pairs).otherwise(none)


def similar_words(queries: DataFrame, words: DataFrame, *, top: int = 10, n: int = 2, skip: int = 1) -> DataFrame:
    """query, rank, token and score (cosine of the skip-gram sets) of the `top` most similar tokens of each query.

    Both sides meet in an inverted index on skip-grams; queries (column query) are few, words (column token) many.
    """
    grams = lambda df, c: df.select(c, skipgrams(F.col(c), n, skip).alias("g")).select(c, F.size("g").alias(f"n_{c}"), F.explode("g").alias("g"))
    both = grams(queries.distinct(), "query").join(grams(words.select("token").distinct(), "token"), "g")
    score = F.count("*") / F.sqrt(F.first("n_query") * F.first("n_token"))
    scored = both.groupBy("query", "token").agg(score.alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query", "rank", "token", "score")


QUERIES_PER_BLOCK, WORDS_PER_BLOCK = 50_000, 400_000
_BITS = 64


def _gram_ids(words: pa.Array, skip: int) -> tuple[np.ndarray, np.ndarray, int]:
    """row and number of each distinct skip-gram of words in small letters, row by row; and how many there are."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    chars = np.frombuffer("".join(f"#{w}#" for w in words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), size)
    code = _codes(chars)
    letters = int(code.max()) + 1
    rows, keys = [], []
    for d in range(1, skip + 2):
        at = np.flatnonzero(row[d:] == row[:-d])
        rows.append(row[at])
        keys.append(code[at] * letters + code[at + d])
    gram = _codes(np.concatenate(keys))
    grams = int(gram.max()) + 1
    both = np.sort(np.concatenate(rows) * grams + gram)
    both = both[np.append(True, both[1:] != both[:-1])]
    return both // grams, both % grams, grams


def _codes(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct ones of some whole numbers, in their order."""
    if values.max() >= 1 << 24:
        return np.unique(values, return_inverse=True)[1]
    there = np.zeros(int(values.max()) + 1, bool)
    there[values] = True
    return (np.cumsum(there) - 1)[values]


class _Vocabulary:
    """Words in the order of their numbers of grams; those that share enough grams with a query are found by two
    bitmaps of 64 bits, in each of which a gram has one bit, and then counted."""

    def __init__(self, row: np.ndarray, gram: np.ndarray, rows: int, grams: int) -> None:
        rank = np.empty(grams, np.int64)
        rank[np.argsort(-np.bincount(gram, minlength=grams), kind="stable")] = np.arange(grams)
        turn, place = rank // _BITS, rank % _BITS
        self.bits = [np.uint64(1) << b.astype(np.uint64) for b in (np.where(turn % 2 == 0, place, _BITS - 1 - place), (rank * 2654435761 >> 13) % _BITS)]
        size = np.bincount(row, minlength=rows)
        start = np.cumsum(size) - size
        self.order = np.argsort(size, kind="stable")
        self.maps = [np.bitwise_or.reduceat(b[gram], start)[self.order] for b in self.bits]
        self.n, many = np.unique(size, return_counts=True)
        self.end = np.append(0, np.cumsum(many))
        in_order = np.repeat(start[self.order], size[self.order]) + np.arange(len(row)) - np.repeat(np.cumsum(size[self.order]) - size[self.order], size[self.order])
        flat = gram[in_order].astype(np.int32)
        edge = np.append(0, np.cumsum(many * self.n))
        self.grams = [flat[edge[k] : edge[k + 1]].reshape(-1, n) for k, n in enumerate(self.n)]
        self.asked = np.zeros(grams, bool)

    def nearest(self, grams: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and cosines of the `top` nearest of a query, and of others as near as the last; words without a common gram don't count."""
        nq = len(grams)
        maps = [np.bitwise_or.reduce(b[grams]) for b in self.bits]
        spare = [nq - int(np.bitwise_count(m)) for m in maps]  # grams of the query that share a bit
        self.asked[grams] = True
        at, score, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for k in np.argsort(-np.minimum(self.n, nq) / np.maximum(self.n, nq), kind="stable"):
            n = int(self.n[k])
            root = np.sqrt(np.float64(nq * n))
            if min(nq, n) / root < least:  # nor has any other number of grams a word that is near enough
                break
            a, end, step = self.end[k], self.end[k + 1], 2048 if len(at) < top else 1 << 14 if least < 0.6 else 1 << 20
            while a < end:
                b = min(a + step, end)
                need = max(1, int(least * root) - 1)
                while need / root < least:
                    need += 1
                if need > min(nq, n):
                    break
                found = np.flatnonzero(np.bitwise_count(self.maps[0][a:b] & maps[0]) >= need - spare[0]) if need > spare[0] else np.arange(b - a)
                found += a
                if need > spare[1]:
                    found = found[np.bitwise_count(self.maps[1][found] & maps[1]) >= need - spare[1]]
                if len(found):
                    common = self.asked[self.grams[k][found - self.end[k]]].sum(axis=1)
                    enough = common >= need
                    at, score = np.append(at, found[enough]), np.append(score, common[enough] / root)
                    if len(score) >= top:
                        least = np.partition(score, len(score) - top)[len(score) - top]
                        at, score = at[score >= least], score[score >= least]
                a, step = b, step * 8
        self.asked[grams] = False
        return self.order[at], score


def similar_vocabulary(words: DataFrame, queries: DataFrame | None = None, *, top: int = 10, n: int = 2, skip: int = 1) -> DataFrame:
    """As `similar_words` with many queries (column query), by default every token of `words`.

    A block of queries meets a block of the vocabulary in a task, which keeps the `top` of each query; the best of all
    blocks are the result. Blocks are of bounded size, and no more than it takes to have all cores busy, as the
    vocabulary is shuffled once for each block of queries; the time grows with queries times vocabulary.
    """
    if n != 2:
        raise ValueError("skip-grams have two letters")
    own_rows = lambda df: df.where("token is not null").distinct().select("token", F.lower("token").alias("low"))
    vocabulary = own_rows(words.select("token"))
    asked = vocabulary if queries is None else own_rows(queries.select(F.col("query").alias("token")))
    wide = max(1, -(-vocabulary.count() // WORDS_PER_BLOCK))
    tasks = 4 * words.sparkSession.sparkContext.defaultParallelism
    tall = max(1, -(-asked.count() // QUERIES_PER_BLOCK), tasks // wide)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    block = (F.col("v") + F.col("q") * wide).alias("block")
    rows = asked.select("*", own("low", tall).alias("q"), every(wide).alias("v")).select("token", "low", block)
    others = vocabulary.select("*", every(tall).alias("q"), own("token", wide).alias("v")).select("token", "low", block)

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return pa.table({"query": pa.array([], pa.string()), "token": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        found = found.sort_by("token")
        tokens, lows = found["token"].combine_chunks(), asked["low"].combine_chunks().dictionary_encode()
        low = lows.indices.to_numpy(zero_copy_only=False)
        row, gram, grams = _gram_ids(pa.concat_arrays([found["low"].combine_chunks(), lows.dictionary]), skip)
        many = len(tokens)
        edge = np.searchsorted(row, np.arange(many, many + len(lows.dictionary) + 1))
        known = _Vocabulary(row[: edge[0]], gram[: edge[0]], many, grams)
        best, score = [], []
        for a, b in zip(edge, edge[1:]):  # words that differ in capitals alone have the same grams
            at, s = known.nearest(gram[a:b], top)
            keep = np.lexsort((at, -s))[:top]
            best.append(at[keep])
            score.append(s[keep])
        place, query = np.concatenate([best[k] for k in low]), np.repeat(np.arange(len(low)), [len(best[k]) for k in low])
        return pa.table({"query": asked["token"].combine_chunks().take(pa.array(query)), "token": tokens.take(pa.array(place)), "score": np.concatenate([score[k] for k in low])})

    blocks = wide * tall
    # one partition for each block, as far as hashes spread them
    scored = rows.repartition(blocks, "block").groupBy("block").cogroup(others.repartition(blocks, "block").groupBy("block")).applyInArrow(run, "query string, token string, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query", "rank", "token", "score")
