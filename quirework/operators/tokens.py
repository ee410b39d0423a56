"""Token statistics: frequencies by position in the line, merging of analyses, keyness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

POSITIONS = ("all", "start", "mid", "end")
_EPSILON = 1e-20


def line_tokens(lines: DataFrame, kind: str, *, keys: list[str] = [], text: str = "text", break_chars: str = "-", ignorecase: bool = False) -> DataFrame:
    """`keys`, token, pos (from 0) and n (tokens of the line); `kind` is 'char' or 'word'. Null and empty lines give none."""
    t = F.lower(text) if ignorecase else F.col(text)
    tokens = F.split(t, "") if kind == "char" else T.line_words(t, break_chars)
    some = lines.where(F.length(text) > 0).select(*keys, tokens.alias("__t"))
    # a plain posexplode brings a filter on the size, for which the tokens are made a second time
    return some.select(*keys, F.size("__t").alias("n"), F.posexplode_outer("__t").alias("pos", "token")).where("pos is not null")


def position_frequencies(tokens: DataFrame, kind: str, keys: list[str] = []) -> DataFrame:
    """`keys`, token and its frequency in all, start, mid and end position.

    A line of one word is start and end; a line of one character is start only.
    """
    first, last = F.col("pos") == 0, F.col("pos") == F.col("n") - 1
    end = last & (F.col("n") > 1) if kind == "char" else last
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("all_freq"), F.count_if(first).alias("start_freq"), F.count_if(~first & ~last).alias("mid_freq"), F.count_if(end).alias("end_freq"))


def position_fractions(freq: DataFrame) -> DataFrame:
    """Adds each position's fraction of its total, and that relative to the fraction of all; null where a total is 0."""
    totals = freq.agg(*[F.sum(f"{p}_freq").alias(f"__{p}") for p in POSITIONS])
    out = freq.crossJoin(F.broadcast(totals))  # one row
    out = out.withColumns({f"{p}_frac": F.try_divide(f"{p}_freq", f"__{p}") for p in POSITIONS})
    out = out.withColumns({f"{p}_rel_frac": F.try_divide(f"{p}_frac", F.col("all_frac")) for p in POSITIONS[1:]})
    return out.drop(*[f"__{p}" for p in POSITIONS])


def position_totals(freq: DataFrame) -> DataFrame:
    """position, num_types and num_tokens."""
    cols = ", ".join(f"'{p}', {p}_freq" for p in POSITIONS)
    long = freq.selectExpr(f"stack({len(POSITIONS)}, {cols}) AS (position, freq)")
    return long.groupBy("position").agg(F.count_if(F.col("freq") > 0).alias("num_types"), F.sum("freq").alias("num_tokens"))


def merge_analyses(*freqs: DataFrame) -> DataFrame:
    """Sum of several analyses of one kind."""
    out = freqs[0]
    for f in freqs[1:]:
        out = out.unionByName(f)
    return out.groupBy("token").agg(*[F.sum(f"{p}_freq").alias(f"{p}_freq") for p in POSITIONS])


def _term(observed: Column, expected: Column) -> Column:
    return observed * F.log((observed + _EPSILON) / (expected + _EPSILON))


def keyness(target: DataFrame, reference: DataFrame) -> DataFrame:
    """token, target_freq, reference_freq, log_likelihood (G2 over the 2x2 table) and direction of every token of either
    side; inputs have token and freq. `more` only where the target's share is above what is expected."""
    t = target.select("token", F.col("freq").alias("target_freq"))
    r = reference.select("token", F.col("freq").alias("reference_freq"))
    totals = t.agg(F.sum("target_freq").alias("tn")).crossJoin(r.agg(F.sum("reference_freq").alias("rn")))
    both = t.join(r, "token", "full_outer").na.fill(0, ["target_freq", "reference_freq"]).crossJoin(F.broadcast(totals)).na.fill(0, ["tn", "rn"])
    a, b = F.col("target_freq"), F.col("reference_freq")
    tn, rn = F.col("tn"), F.col("rn")
    c, d, n = tn - a, rn - b, tn + rn
    ea, eb, ec, ed = [F.try_divide(x * y, n) for x, y in ((a + b, tn), (a + b, rn), (c + d, tn), (c + d, rn))]
    g2 = 2 * (_term(a, ea) + _term(b, eb) + _term(c, ec) + _term(d, ed))
    return both.select("token", "target_freq", "reference_freq", g2.alias("log_likelihood"), F.when(a > ea, "more").otherwise("less").alias("direction"))


def complement_keyness(total: DataFrame, part: DataFrame) -> DataFrame:
    """Keyness of a part against the rest of the whole that it belongs to; inputs have token and freq."""
    rest = total.join(part.select("token", F.col("freq").alias("__p")), "token", "left").select("token", (F.col("freq") - F.coalesce("__p", F.lit(0))).alias("freq"))
    return keyness(part, rest.where("freq > 0"))


def word_frequency(lines: DataFrame, *, text: str = "text", keys: list[str] = []) -> DataFrame:
    """`keys`, token and freq of the runs of word characters."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return lines.select(*keys, F.explode(words).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("freq"))
