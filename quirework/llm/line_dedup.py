"""Removal of repeated passages: runs of at least `min_words` words that also stand earlier, wherever in a line they
begin or end; and, as a part of its own, a distributed suffix array over whole lines.

Words are what ASCII white space parts, compared byte by byte; the white space between them isn't compared, so that a
passage is found where it is wrapped differently. A run of `min_words` words or more stands earlier (by document id,
then word) if and only if each of its windows of `min_words` words does; so the words to delete are those of all windows
whose hash has an earlier place, and nothing is sampled or rounded to sentences or lines. To keep windows that occur
once out of the shuffle, each window names one of its runs of half the words (winnowing: the one with the least hash, the
last of equals); equal windows name equal runs, so only windows whose run is named by another text, or twice in its
own, are placed. Exact copies of a text take part once; all words of the later ones go, if the text has `min_words`.

The suffix array (`_edited`) takes lines as units: suffixes are named by their first four lines' ids, then refined by
prefix doubling, two doublings in a round, in a window over the name's class alone; neighbours in the array that share
their first lines up to `min_words` words get their longest common prefixes, and a scan of the LCP intervals yields for
every suffix the longest run of whole lines that also stands earlier.

Defined results: a null text stays null and an empty one empty; a document that loses words keeps the others with the
white space before each, and across a gap the white space of that end of it with more line breaks; one that loses all of
them goes; documents are ordered by id, a null id last, then by hashes of the text; rows that repeat an id and a text are
one document and all get its result; a run may repeat within one document, too, and overlap itself; an empty table gives
an empty result; other columns are kept, by any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import likely, materialise, text_slices, trimmed
from ._hashing import VERBATIM, mix, string_buffers, word_hashes, word_spans

MIN_WORDS = 25
#: lines that name a suffix before the first round
FIRST = 4
#: words of 64 bits of the bitmap of texts concerned
BITMAP = 1 << 17
#: bytes of text in a slice, and parts that rows go to whose fate is known in their slice
_SLICE, _PARTS = 2 << 20, 1 << 16
_KEY = ["k", "k2"]
_PLACE = [*_KEY, "at"]
_END = -(1 << 63)


def _keys(text_col: str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), F.col(text_col)), F.xxhash64(F.lit(2), F.col(text_col))


def _words(line: Column) -> Column:
    return F.when(F.trim(line) == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n", -1)


def text_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, k2, first (the smallest id, nulls last) and copied (whether other ids have the text, too) of every text."""
    k, k2 = _keys(text_col)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), k.alias("k"), k2.alias("k2"))
    found = texts.groupBy(*_KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or(F.col("id").isNull()).alias("null"))
    return found.select(*_KEY, "first", (F.col("first").isNotNull() & (F.col("null") | (F.col("first") < F.col("last")))).alias("copied"))


def repeated_lines(docs: DataFrame, copied: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each text with repeated lines: id, k, k2 and, line by line, at, h (line id) and w (words)."""
    k, k2 = _keys(text_col)
    some = docs.where(F.col(text_col).isNotNull())
    many = some.select(F.explode(_lines(text_col)).alias("line")).select(F.xxhash64("line").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    lines = some.select(F.col(id_col).alias("id"), k.alias("k"), k2.alias("k2"), F.posexplode(_lines(text_col)).alias("at", "line"))
    own = lines.select("id", *_PLACE, F.xxhash64("line").alias("h"), _words(F.col("line")).alias("w")).join(many, "h")
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    firsts = own.join(copied, _KEY, "left").where(~later)
    lists = firsts.groupBy(*_KEY).agg(F.min("id").alias("id"), F.array_sort(F.collect_set(F.struct("at", "h", "w"))).alias("l"))
    return lists.select("id", *_KEY, F.col("l.at").alias("at"), F.col("l.h").alias("h"), F.col("l.w").alias("w"))


def _flat(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False)


def suffixes(texts: DataFrame, min_words: int) -> DataFrame:
    """A row for each suffix of repeated lines: its place, left (lines to the end of its run), name (the first lines'
    ids and a rank, 0), and g and m: hash and number of the first lines that hold `min_words` words, null if none do."""
    id_type = texts.schema["id"].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                at, h, w = (_flat(b.column(c)) for c in (3, 4, 5))
                n = len(at)
                if not n:
                    continue
                sizes = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), sizes)
                breaks = np.ones(n, bool)
                breaks[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                starts = np.flatnonzero(breaks)
                ends = np.append(starts[1:], n)
                run_of = np.cumsum(breaks) - 1
                place = np.arange(n)
                left = ends[run_of] - place
                upto = np.cumsum(w.astype(np.int64))
                last = np.searchsorted(upto, upto - w + min_words)  # the line that brings the words to min_words
                enough = last < ends[run_of]
                names = np.full((n, FIRST + 1), _END, np.int64)
                names[:, FIRST] = 0
                for i in range(FIRST):
                    on = left > i
                    names[on, i] = h[place[on] + i]
                with np.errstate(over="ignore"):
                    # a hash of each range of lines from prefix sums of powers
                    base = np.uint64(0x9E3779B97F4A7C15)
                    inner = place - starts[run_of]
                    power = np.cumprod(np.full(int(inner.max()) + 2, base, np.uint64))
                    terms = mix(h.view(np.uint64)) * power[inner]
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
                    inverse = np.cumprod(np.full(len(power), np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
                    stop = np.where(enough, last, place)
                    g = mix((total[stop + 1] - total[place]) * inverse[inner])
                take = pa.array(row)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * (FIRST + 1) + 1, FIRST + 1, dtype=np.int32)), pa.array(names.ravel()))
                m = (stop - place + 1).astype(np.int32)
                cols = [b.column(c).take(take) for c in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at.astype(np.int32)), pa.array(left.astype(np.int32)), lists, pa.array(g.view(np.int64), mask=~enough), pa.array(m, mask=~enough)], ["id", "k", "k2", "at", "left", "name", "g", "m"])

    return texts.mapInArrow(run, f"id {id_type}, k long, k2 long, at int, left int, name array<long>, g long, m int")


def suffix_array(sfx: DataFrame) -> DataFrame:
    """`sfx` with names whose order is that of the suffixes; equal names are equal suffixes.

    Prefix doubling, two doublings in a round: names of L lines become names of 4 L lines. A suffix of exactly L lines
    stays for the round that tells it from longer ones.
    """
    same = Window.partitionBy("c")
    now = sfx.withColumn("c", F.xxhash64(F.slice("name", 1, FIRST))).withColumn("open", (F.count("*").over(same) > 1) & (F.col("left") >= FIRST))
    now = materialise(now, "named")
    done: DataFrame | None = None
    step = FIRST
    while not now.where("open").isEmpty():
        doc = Window.partitionBy(*_KEY).orderBy("at")
        ahead = [F.when(F.col("left") > i * step, F.max("name").over(doc.rangeBetween(i * step, i * step))) for i in (1, 2, 3)]
        seen = now.withColumns({f"a{i}": a for i, a in enumerate(ahead, 1)})
        order = Window.partitionBy("c", F.element_at("name", -1)).orderBy(*[F.col(f"a{i}").asc_nulls_first() for i in (1, 2, 3)])
        three = F.struct("a1", "a2", "a3")
        ranked = seen.where("open").withColumns({"rank": F.rank().over(order) - 1, "__p": F.lag(three).over(order), "__n": F.lead(three).over(order)})
        again = F.coalesce(F.col("__p") == three, F.lit(False)) | F.coalesce(F.col("__n") == three, F.lit(False))
        name = F.concat(F.slice("name", 1, FIRST), F.array(F.element_at("name", -1) + F.col("rank")))
        ranked = ranked.select("id", *_PLACE, "left", name.alias("name"), "g", "m", "c", ((F.col("left") >= 4 * step) & again).alias("open"))
        closed = now.where("not open").select(ranked.columns)  # these aren't written again
        done = closed if done is None else done.unionByName(closed)
        now = materialise(ranked, "ranked")
        step *= 4
    return now if done is None else done.unionByName(now.select(done.columns))


def neighbours(array: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the suffixes that share their first `min_words` words with another, in array order: g, seq (place in it), ord
    (place in the corpus), place and lcp with the one before (0 for the first)."""
    own = array.where("g is not null")
    by_place = [F.col("id").asc_nulls_last(), *_PLACE]
    w = Window.partitionBy("g").orderBy("name", *by_place)
    cols = {f"p_{c}": F.lag(c).over(w) for c in [*_PLACE, "left"]}
    own = own.withColumns(cols | {"seq": F.row_number().over(w), "__next": F.lead("at").over(w)}).where("p_at is not null or __next is not null")
    own = own.withColumn("ord", F.row_number().over(Window.partitionBy("g").orderBy(*by_place)))
    most = F.least("left", "p_left")
    keep = own.select("g", "seq", "ord", *_PLACE, "p_k", "p_k2", "p_at", "m", most.alias("most"))
    keep = materialise(keep, "neighbours")
    known = F.when(F.col("p_at").isNull(), 0).when(F.col("m") == F.col("most"), F.col("m"))
    sure = keep.where(F.col("p_at").isNull() | (F.col("m") == F.col("most"))).select("g", "seq", "ord", *_PLACE, known.alias("lcp"))
    unsure = keep.where("p_at is not null and m < most")
    row = F.struct("at", "p_at", "m", "most", "g", "seq", "ord")
    by_pair = unsure.groupBy(*_KEY, "p_k", "p_k2").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    mine = texts.select(*_KEY, F.col("at").alias("a_at"), F.col("h").alias("a_h"))
    theirs = texts.select(F.col("k").alias("p_k"), F.col("k2").alias("p_k2"), F.col("at").alias("b_at"), F.col("h").alias("b_h"))
    both = by_pair.join(mine, _KEY).join(theirs, ["p_k", "p_k2"]).select(*_KEY, "rows", "a_at", "a_h", "b_at", "b_h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in range(b.num_rows):
                k, k2 = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                a_at, a_h, b_at, b_h = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6))
                gap = end = None  # of the last comparison: how far the two texts are apart, and where they stop agreeing
                rows = b.column(2)[r].values
                fields = [f.to_numpy(zero_copy_only=False).tolist() for f in rows.flatten()]
                for at, p_at, m, most, g, seq, o in zip(*fields):
                    if gap != p_at - at or end is None or end - at < m:
                        x, y = np.searchsorted(a_at, at), np.searchsorted(b_at, p_at)
                        n, step = m, 64
                        while n < most:
                            to = min(most, n + step)
                            differ = np.flatnonzero(a_h[x + n : x + to] != b_h[y + n : y + to])
                            if len(differ):
                                n += int(differ[0])
                                break
                            n, step = to, step * 4
                        gap, end = p_at - at, at + n
                    out.append((g, seq, o, k, k2, at, min(most, end - at)))
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["g", "seq", "ord", *_PLACE, "lcp"])

    found = both.mapInArrow(compare, "g long, seq int, ord int, k long, k2 long, at int, lcp int")
    return sure.unionByName(found)


def earlier_runs(pairs: DataFrame) -> DataFrame:
    """For each suffix of which a beginning also stands earlier: k, k2, at and the most lines (best)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[list] = []  # [ord, lcp with the one below, place]; ord grows upwards
        first = None

        def close(entry: list, right: int) -> None:
            best = max(entry[1], right)
            if best:
                out.append((*entry[2], best))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], [*_PLACE, "best"])

        for b in batches:
            for g, o, lcp, *place in zip(*(c.to_pylist() for c in b.columns)):
                if g != first:
                    while stack:
                        close(stack.pop(), 0)
                    first = g
                while stack and stack[-1][0] > o:
                    top = stack.pop()
                    close(top, lcp)
                    lcp = min(lcp, top[1])
                stack.append([o, lcp if stack else 0, place])
            if out:
                yield flush()
        while stack:
            close(stack.pop(), 0)
        yield flush()

    rows = pairs.repartition("g").sortWithinPartitions("g", "seq")
    return rows.select("g", "ord", "lcp", *_PLACE).mapInArrow(run, "k long, k2 long, at int, best int")


def deleted_ranges(docs: DataFrame, copied: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k, k2 and ranges (array of start and end, apart from each other) of the lines to delete in a text's first document."""
    texts = materialise(repeated_lines(docs, copied, id_col, text_col), "repeated")
    found = earlier_runs(neighbours(suffix_array(suffixes(texts, min_words)), texts)).withColumn("to", F.col("at") + F.col("best"))
    doc = Window.partitionBy(*_KEY).orderBy("at")
    reach = F.max("to").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) < F.col("at")).cast("int")).withColumn("island", F.sum("fresh").over(doc))
    merged = islands.groupBy(*_KEY, "island").agg(F.min("at").alias("s"), F.max("to").alias("e"))
    return merged.groupBy(*_KEY).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))


def _edited(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """`docs` with its text edited and the columns __qw_left and __qw_deleted (lines)."""
    copied = materialise(text_units(docs, id_col, text_col).where("copied").select(*_KEY, "first"), "copied")
    ranges = deleted_ranges(docs, copied, id_col=id_col, text_col=text_col, min_words=min_words)
    hits = materialise(ranges.join(copied, _KEY, "full_outer"), "hits").toDF("__qw_k", "__qw_k2", "__qw_ranges", "__qw_first")
    k, k2 = _keys(text_col)
    same = (F.col("__qw_a") == F.col("__qw_k")) & (F.col("__qw_b") == F.col("__qw_k2"))
    # the texts are shuffled but not sorted: a hash table holds the texts that lose lines
    joined = docs.withColumns({"__qw_a": k, "__qw_b": k2}).join(hits.hint("shuffle_hash"), same, "left")
    lines = _lines(text_col)
    later = F.col("__qw_first").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) > F.col("__qw_first")))
    words = F.aggregate(F.transform(lines, _words), F.lit(0), lambda s, n: s + n)
    all_gone = later & (words >= min_words)
    gone = lambda i: F.exists("__qw_ranges", lambda r: (i >= r["s"]) & (i < r["e"]))
    kept = F.filter(lines, lambda line, i: ~gone(i))
    some_gone = ~later & F.col("__qw_ranges").isNotNull()
    deleted = F.when(all_gone, F.size(lines)).when(some_gone, F.aggregate("__qw_ranges", F.lit(0), lambda acc, r: acc + r["e"] - r["s"])).otherwise(0)
    out = joined.withColumns({"__qw_deleted": deleted, "__qw_all": F.when(F.col("__qw_k").isNull(), 1).otherwise(F.size(lines))})
    return out.withColumns(
        {
            "__qw_left": F.when(F.col("__qw_deleted") > 0, F.col("__qw_all") - F.col("__qw_deleted")).otherwise(1),
            text_col: F.when(F.col("__qw_deleted") == 0, F.col(text_col)).when(some_gone, F.array_join(kept, "\n")),
        }
    )


def windows(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of `min_words` words within a text: its row, first word (in the row), hash, the place of the run
    that it names (in all words), and that run's hash."""
    h, first = word_hashes(data, offsets, VERBATIM)
    half = (min_words + 1) // 2
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(len(h) - min_words + 1, 0)
    at = np.flatnonzero(row[:n] == row[min_words - 1 : min_words - 1 + n])
    with np.errstate(over="ignore"):
        runs = _rolled(h, half)
        named, best = np.arange(n), runs[:n].copy()
        for i in range(1, min_words - half + 1):
            less = runs[i : i + n] <= best
            best[less] = runs[i : i + n][less]
            named[less] = np.flatnonzero(less) + i
        whole = _rolled(h, min_words)
    return row[at], at - first[row[at]], whole[at], named[at], best[at]


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return mix(out)


def shared_anchors(docs: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """k, k2 and anchors (hashes of named runs that another text names, too, or the same text twice) of texts with any.

    Of the texts of a slice that name one run, one speaks for all in the shuffle; the others, of which sharing is known
    by then, are spread: a run in a third of all texts is a row for each slice in one task.
    """
    k, k2 = _keys(text_col)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t", _SLICE):
            row, _, _, named, anchor = windows(*string_buffers(b.column(2)), min_words)
            new = np.ones(len(row), bool)
            new[1:] = (named[1:] != named[:-1]) | (row[1:] != row[:-1])
            row, anchor = row[new], anchor[new]
            order = np.lexsort((row, anchor))
            row, anchor = row[order], anchor[order]
            start = np.ones(len(row), bool)
            start[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(start)
            twice = np.diff(np.append(at, len(row))) > 1
            row, anchor = row[at], anchor[at]
            if not len(row):
                continue
            first = np.ones(len(row), bool)
            first[1:] = anchor[1:] != anchor[:-1]
            run_of, heads = np.cumsum(first) - 1, np.flatnonzero(first)
            key = b.column(0).to_numpy()[row]
            # copies of a text have one key, so they don't make its runs shared
            shared = np.logical_or.reduceat(twice | (key != key[heads][run_of]), heads)[run_of]
            part = np.where(first | ~shared, 0, 1 + key % _PARTS)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(shared), pa.array(part.astype(np.int32))], ["k", "k2", "a", "known", "part"])

    some = docs.where(F.col(text_col).isNotNull()).select(k.alias("k"), k2.alias("k2"), F.col(text_col).alias("t"))
    named = some.mapInArrow(run, "k long, k2 long, a long, known boolean, part int")
    w = Window.partitionBy("a", "part")
    found = named.withColumn("s", F.max("known").over(w) | (F.min("k").over(w) < F.max("k").over(w))).where("s")
    return found.groupBy(*_KEY).agg(F.collect_set("a").alias("anchors"))


def placed_windows(texts: DataFrame, min_words: int) -> DataFrame:
    """g (hash), id, k, k2 and at (first word) of the windows of `texts` (id, k, k2, anchors, t) that name an anchor; and
    part: 0, or another number if an equal window of the same slice is known to stand earlier."""
    id_type = texts.schema["id"].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t", _SLICE):
            row, at, g, _, anchor = windows(*string_buffers(b.column(4)), min_words)
            # an anchor of another text of the slice does no harm: a window of one place isn't deleted
            on = np.isin(anchor, _flat(b.column(3)).view(np.uint64))
            row, at, g = row[on], at[on], g[on]
            if not len(row):
                continue
            order = pc.sort_indices(pa.table(b.columns[:3], names=["id", "k", "k2"]), sort_keys=[("id", "ascending"), ("k", "ascending"), ("k2", "ascending")], null_placement="at_end").to_numpy()
            k, k2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            rank = np.empty(len(order), np.int64)  # rows of one text are one document
            rank[order] = np.cumsum(np.append(False, (k[order[1:]] != k[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])))
            order = np.lexsort((at, rank[row], g))
            row, at, g = row[order], at[order], g[order]
            first = np.ones(len(row), bool)
            first[1:] = g[1:] != g[:-1]
            head = np.flatnonzero(first)[np.cumsum(first) - 1]
            earliest = (rank[row] == rank[row[head]]) & (at == at[head])
            part = np.where(earliest, 0, 1 + (k[row] + at) % _PARTS)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), *(b.column(c).take(take) for c in (0, 1, 2)), pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32))], ["g", "id", *_PLACE, "part"])

    return texts.select("id", *_KEY, "anchors", "t").mapInArrow(run, f"g long, id {id_type}, k long, k2 long, at int, part int")


def _is_later(id_: Column, first: Column) -> Column:
    return F.coalesce(first.isNotNull() & (id_.isNull() | (id_ > first)), F.lit(False))


def deleted_windows(docs: DataFrame, copied: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """k, k2 and ats (first words) of the windows of a text's first document that also stand earlier."""
    k, k2 = _keys(text_col)
    anchors = materialise(shared_anchors(docs, text_col, min_words).join(copied, _KEY, "left"), "anchors")
    some = likely(docs.where(F.col(text_col).isNotNull()), anchors, _keys(text_col), BITMAP).where("__qw_likely")
    texts = some.select(F.col(id_col).alias("id"), k.alias("k"), k2.alias("k2"), F.col(text_col).alias("t"))
    own = texts.join(anchors.hint("shuffle_hash"), _KEY).where(~_is_later(F.col("id"), F.col("first")))
    place = F.struct(F.col("id").isNull().alias("n"), "id", *_PLACE)
    found = placed_windows(own, min_words).withColumn("o", F.min(place).over(Window.partitionBy("g", "part")))
    return found.where((F.col("part") > 0) | (place != F.col("o"))).groupBy(*_KEY).agg(F.collect_set("at").alias("ats"))


def without_words(text: str, gone: np.ndarray, spans: tuple[np.ndarray, np.ndarray]) -> str | None:
    """`text` without its words that are `gone`; null if none is left. `spans`: of the words, in bytes."""
    data = text.encode("utf-8", "surrogatepass")
    s, e = spans
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return None
    out = []
    # runs of kept words keep what is between them
    starts = kept[np.append(True, np.diff(kept) > 1)]
    ends = kept[np.append(np.diff(kept) > 1, True)]
    for i, (a, b) in enumerate(zip(starts, ends)):
        if i:
            left, right = data[e[ends[i - 1]] : s[ends[i - 1] + 1]], data[e[a - 1] : s[a]]
            out.append(left if left.count(b"\n") > right.count(b"\n") else right)
        elif a == 0:
            out.append(data[: s[0]])
        out.append(data[s[a] : e[b]])
    if kept[-1] == len(gone) - 1:
        out.append(data[e[-1] :])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _without_passages(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """`docs` with its text without repeated passages and the columns __qw_left and __qw_deleted (words)."""
    copied = materialise(text_units(docs, id_col, text_col).where("copied").select(*_KEY, "first"), "copied")
    found = deleted_windows(docs, copied, id_col, text_col, min_words)
    found = materialise(found.join(copied, _KEY, "full_outer").select(*_KEY, "ats", "first"), "hits")
    hits = found.toDF("__qw_k", "__qw_k2", "__qw_ats", "__qw_first")

    @F.pandas_udf("text string, deleted int, left int")
    def edit(texts: pd.Series, ats: pd.Series, later: pd.Series) -> pd.DataFrame:
        out = []
        for t, at, all_gone in zip(texts, ats, later):
            if t is None:
                out.append((None, 0, 1))
                continue
            data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            s, e = word_spans(VERBATIM[data] != 0, np.array([0, len(data)]))
            n = len(s)
            gone = np.zeros(n, bool)
            if all_gone:
                gone[:] = n >= min_words
            elif at is not None:
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, np.asarray(at), 1)
                np.add.at(step, np.asarray(at) + min_words, -1)
                gone = np.cumsum(step)[:n] > 0
            many = int(gone.sum())
            out.append((without_words(t, gone, (s, e)) if many else t, many, n - many if many else 1))
        return pd.DataFrame(out, columns=["text", "deleted", "left"])

    k, k2 = _keys(text_col)
    same = (F.col("__qw_a") == F.col("__qw_k")) & (F.col("__qw_b") == F.col("__qw_k2"))
    all_docs = likely(docs, found, _keys(text_col), BITMAP)
    # only texts that may lose words are shuffled, and not sorted: a hash table holds what they lose
    joined = all_docs.where("__qw_likely").drop("__qw_likely").withColumns({"__qw_a": k, "__qw_b": k2}).join(hits.hint("shuffle_hash"), same, "left")
    later = _is_later(F.col(id_col), F.col("__qw_first"))
    concerned = F.when(later | F.col("__qw_ats").isNotNull(), F.col(text_col))
    # declared so, a filter of its result isn't pushed below it, which would edit each text twice, in a second worker
    once = edit.asNondeterministic()
    out = joined.withColumn("__qw_e", once(concerned, F.when(~later, F.col("__qw_ats")), later))
    changed = F.col("__qw_e.deleted") > 0
    edited = out.withColumns({"__qw_deleted": F.col("__qw_e.deleted"), "__qw_left": F.col("__qw_e.left"), text_col: F.when(changed, F.col("__qw_e.text")).otherwise(F.col(text_col))})
    own = [*docs.columns, "__qw_deleted", "__qw_left"]
    others = all_docs.where(~F.col("__qw_likely")).withColumns({"__qw_deleted": F.lit(0), "__qw_left": F.lit(1)})
    return edited.select(own).unionByName(others.select(own))


def drop_repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs`, all columns, without the words of repeated passages; rows without a word left go.

    `count_col`: a column whose whole number follows the length of the text in characters, if it held it before.
    """
    out = _without_passages(docs, id_col, text_col, min_words).where("__qw_left > 0")
    if count_col:
        out = out.withColumn(count_col, F.when(F.col("__qw_deleted") > 0, F.length(text_col).cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col)))
    return out.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with the number of words deleted and the text that is left (null if nothing is)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = _without_passages(docs, "doc_id", "text", MIN_WORDS)
    return out.select("doc_id", F.col("__qw_deleted").alias("deleted_words"), F.when(F.col("__qw_left") > 0, F.col("text")).alias("text"))


QUERY, ORACLE = ("op9_line_dedup", query), None
