"""Lines to running text: a model of how words break at line ends, decisions for each pair of lines, paragraphs with line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_COMMON = 1000
_TYPICAL = 100


def _marks(break_chars: str) -> str:
    return "".join("\\" + c for c in break_chars)


def with_words(lines: DataFrame, *, text: str = "text", break_chars: str = "-", ignorecase: bool = False) -> DataFrame:
    t = F.lower(text) if ignorecase else F.col(text)
    return lines.withColumn("words", T.line_words(t, break_chars))


def word_frequencies(lines: DataFrame) -> DataFrame:
    """word and its counts in all, start, mid and end position; a line's only word is its start and its end."""
    n = F.size("words")
    # not filtered by size, as for that the words would be made a second time
    long = lines.select(n.alias("n"), F.posexplode_outer("words").alias("pos", "word")).where("pos is not null")
    first, last = F.col("pos") == 0, F.col("pos") == F.col("n") - 1
    return long.groupBy("word").agg(F.count("*").alias("all"), F.count_if(first).alias("start"), F.count_if(~first & ~last).alias("mid"), F.count_if(last).alias("end"))


def mid_bigrams(lines: DataFrame, freq: DataFrame, min_freq: int = 5) -> DataFrame:
    """first, second and freq of neighbours inside lines, both at least `min_freq` times inside lines; the last pair of a line doesn't count."""
    mid = F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0)))
    n = F.greatest(F.size("m") - 2, F.lit(0))
    pairs = lines.where(F.size("words") > 4).withColumn("m", mid).select(F.explode(F.arrays_zip(F.slice("m", F.lit(1), n).alias("first"), F.slice("m", F.lit(2), n).alias("second"))).alias("p")).select("p.first", "p.second")
    often = freq.where(F.col("mid") >= min_freq).select("word")
    counted = pairs.groupBy("first", "second").agg(F.count("*").alias("freq"))
    return counted.join(often.withColumnRenamed("word", "first"), "first", "left_semi").join(often.withColumnRenamed("word", "second"), "second", "left_semi").select("first", "second", "freq")


def typical_words(freq: DataFrame, side: str, threshold: float = 0.5) -> DataFrame:
    """Words that stand at the `side` (start or end) of lines more than 100 times, and more often than elsewhere."""
    return freq.where((F.col(side) > _TYPICAL) & (F.col(side) / F.col("all") > threshold)).select("word", side, "all")


def line_pairs(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each line with text together with the words of the one before: end_word and start_word (null where there is none)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    some = lines.where(F.col("words").isNotNull())
    out = some.withColumns({"__last": F.when(F.size("words") > 0, F.element_at("words", -1)), "__first": F.get("words", F.lit(0))}).withColumn("__p", F.lag("__last").over(w))
    ok = F.col("__p").isNotNull() & F.col("__first").isNotNull()
    return out.withColumns({"end_word": F.when(ok, F.col("__p")), "start_word": F.when(ok, F.col("__first"))}).drop("__p", "__last", "__first")


def pair_candidates(pairs: DataFrame, freq: DataFrame, break_chars: str = "-") -> DataFrame:
    """Distinct end_word and start_word with n, joined and reduced (without break characters) forms and all frequencies.

    Every look-up is an equality join on a word, so the vocabulary may be of any size.
    """
    found = pairs.where("end_word is not null").groupBy("end_word", "start_word").agg(F.count("*").alias("n"))
    found = found.withColumns({"joined": F.concat("end_word", "start_word"), "reduced": T.without_break(F.col("end_word"), F.col("start_word"), break_chars), "bare": F.regexp_replace("end_word", f"[{_marks(break_chars)}]$", "")})
    for name, cols in {"end_word": ("all", "start", "mid", "end"), "start_word": ("all", "start", "mid", "end"), "joined": ("all", "mid"), "reduced": ("all", "mid")}.items():
        f = freq.select(F.col("word").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])
        found = found.join(f, name, "left").na.fill(0, [f"{name}_{c}" for c in cols])
    return found


def merge_counts(candidates: DataFrame) -> DataFrame:
    """side, word, merges (lines at which the word and its neighbour make a word known from inside lines), and the
    neighbours' words' frequency."""
    more = F.col("joined_mid") > F.col("reduced_mid")
    word, mid = F.when(more, F.col("joined")).otherwise(F.col("reduced")), F.when(more, F.col("joined_mid")).otherwise(F.col("reduced_mid"))
    known = candidates.withColumns({"merge_word": word, "merge_mid": mid}).where("merge_mid > 1")
    sides = [known.select(F.lit(s).alias("side"), F.col(f"{s}_word").alias("word"), "n", "merge_mid") for s in ("start", "end")]
    return sides[0].union(sides[1]).groupBy("side", "word").agg(F.sum("n").alias("merges"), F.sum("merge_mid").alias("merge_freq"))


def merge_classes(freq: DataFrame, merges: DataFrame) -> DataFrame:
    """side, word and class (typical_merge, typical_non_merge, common_merge, common_non_merge) of words at line ends and starts."""
    sides = [freq.select(F.lit(s).alias("side"), "word", F.col(s).alias("here"), "all") for s in ("start", "end")]
    each = sides[0].union(sides[1]).where(F.col("here") > _TYPICAL).join(merges, ["side", "word"], "left")
    share = F.coalesce("merges", F.lit(0)) / F.col("here")
    typical = F.col("here") / F.col("all") > 0.5
    upper = (F.col("side") == "start") & (F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word"))
    kind = (
        F.when(typical & (share > 0.5), "typical_merge")
        .when(typical & (share < 0.05) & ~upper, "typical_non_merge")
        .when(F.col("merges").isNotNull() & (F.col("here") >= _COMMON) & (share < 0.02), "common_non_merge")
        .when(F.col("merges").isNotNull() & (F.col("here") >= _COMMON) & (share >= 0.2) & (F.col("merge_freq") >= 100), "common_merge")
    )
    return each.select("side", "word", kind.alias("class")).where("class is not null")


def decide(candidates: DataFrame, classes: DataFrame, bigrams: DataFrame, break_chars: str = "-") -> DataFrame:
    """end_word, start_word, merges (boolean) and merge_word of every candidate: rules over corpus frequencies, the first that holds."""
    marks = _marks(break_chars)
    c = candidates
    for side in ("start", "end"):
        k = classes.where(F.col("side") == side).select(F.col("word").alias(f"{side}_word"), F.col("class").alias(f"{side}_class"))
        c = c.join(k, f"{side}_word", "left")
    big = bigrams.select(F.col("first").alias("bare"), F.col("second").alias("start_word"), F.col("freq").alias("bigram"))
    c = c.join(big, ["bare", "start_word"], "left").na.fill(0, ["bigram"])
    end, start = F.col("end_word"), F.col("start_word")
    more = F.col("joined_all") > F.col("reduced_all")
    merge, known = F.when(more, F.col("joined")).otherwise(F.col("reduced")), F.when(more, F.col("joined_all")).otherwise(F.col("reduced_all"))
    letter = r"[\p{L}\p{N}_]"
    is_ = lambda col, kind: F.coalesce(F.col(col) == kind, F.lit(False))
    upper = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    capital = lambda w: w.rlike(r"^\p{Lu}")
    never = ~end.rlike(letter) | ~start.rlike(letter) | is_("end_class", "typical_non_merge") | is_("start_class", "typical_non_merge")
    two_words = lambda factor: (F.col("bigram") > factor) & (F.col("bigram") > factor * known)
    seldom_mid = lambda w: (F.col(f"{w}_end") > 5 * F.col(f"{w}_mid")) | (F.col(f"{w}_start") > 5 * F.col(f"{w}_mid"))
    new = (known == 0) & (F.col("joined_all") == 0)
    compound = ~upper(start) & capital(end) & end.rlike("-$") & capital(start) & ~((F.col("start_word_mid") == 0) & new) & ~((F.col("end_word_mid") == 0) & new)
    wrong_case = ~is_("start_class", "common_non_merge") & ~upper(start) & ~((F.col("start_word_all") < 10) & (F.col("end_word_all") < 10)) & seldom_mid("start_word") & seldom_mid("end_word")
    hyphen = end.rlike("-$") & ((known > 0) | ~((F.col("start_word_mid") > F.col("start_word_start")) | start.rlike(T.DIGIT)))
    rules = (
        F.when(never, 0)
        .when(two_words(5), 0)
        .when(capital(start) & compound, 2)
        .when(capital(start) & wrong_case, 1)
        .when(capital(start), 0)
        .when(is_("end_class", "typical_merge") | is_("start_class", "typical_merge"), 1)
        .when(hyphen, 1)
        .when(two_words(2), 0)
        .when(F.col("end_word_mid") >= _COMMON, 0)
        .when(known > 0, 1)
        .when(end.rlike(f"[{marks}]$"), 1)
        .otherwise(0)
    )
    return c.withColumn("rule", rules).select("end_word", "start_word", (F.col("rule") > 0).alias("merges"), F.when(F.col("rule") == 2, F.col("joined")).when(F.col("rule") == 1, merge).alias("merge_word"))


def break_by_character(pairs: DataFrame, break_chars: str = "-") -> DataFrame:
    """Decisions without a model: a line that ends in a break character goes on in the next."""
    found = pairs.where("end_word is not null").select("end_word", "start_word").distinct()
    ends = F.col("end_word").rlike(f"[{_marks(break_chars)}]$")
    return found.select("end_word", "start_word", ends.alias("merges"), F.when(ends, T.without_break(F.col("end_word"), F.col("start_word"), break_chars)).alias("merge_word"))


def paragraphs(lines: DataFrame, keys: list[str], order: str, decisions: DataFrame | None = None, *, text: str = "text", break_chars: str = "-") -> tuple[DataFrame, DataFrame]:
    """(`keys` and paragraph; `keys`, the order column, start and end of each line's text in it). Lines without text are left out.

    `lines` have words (see with_words). Each line is written as it goes on: joined to the next without its break
    character, with it, or with a space; offsets are running sums of what the lines before wrote.
    """
    marks = _marks(break_chars)
    # of the words only the first and the last go on
    some = lines.where(F.length(text) > 0).select(*keys, order, text, F.get("words", F.lit(0)).alias("__first"), F.element_at("words", -1).alias("end_word"))
    w = Window.partitionBy(*keys).orderBy(order)
    nexts = some.withColumns({"start_word": F.lead("__first").over(w), "__more": F.lead(F.lit(1)).over(w)})
    if decisions is None:
        ends = F.coalesce(F.col("end_word").isNotNull() & F.col("start_word").isNotNull() & F.col("end_word").rlike(f"[{marks}]$"), F.lit(False))
        nexts = nexts.withColumns({"merges": ends, "merge_word": F.when(ends, T.without_break(F.col("end_word"), F.col("start_word"), break_chars))})
    else:
        nexts = nexts.join(decisions, ["end_word", "start_word"], "left").na.fill(False, ["merges"])
    t = F.col(text)
    double = t.rlike(f"[{marks}]{{2}}$")
    short = F.when(double, t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)  # one of two break characters
    short_ends, without = short.rlike(f"[{marks}]$"), short.substr(F.lit(1), F.length(short) - 1)
    keeps = F.startswith("merge_word", F.col("end_word"))
    joined = F.when(short_ends & ~keeps, without).otherwise(t)
    apart = F.when(short_ends & (F.length(short) >= 2) & (F.substring(short, -2, 1) != " "), F.concat(without, F.lit(" "), F.substring(short, -1, 1), F.lit(" "))).otherwise(F.concat(short, F.lit(" ")))
    piece = F.when(F.col("__more").isNull(), t).when(F.col("merges"), joined).otherwise(apart)
    pieces = nexts.select(*keys, order, piece.alias("__piece"))
    end = F.sum(F.length("__piece")).over(w)
    ranges = pieces.withColumn("end", end).select(*keys, order, (F.col("end") - F.length("__piece")).alias("start"), "end")
    whole = pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__piece"))), lambda p: p["__piece"]), "").alias("paragraph"))
    return whole, ranges


def broken_lines(lines: DataFrame, keys: list[str], order: str, *, text: str = "text", least: int = 8) -> DataFrame:
    """Lines whose last word of `least` letters or more is cut in half: "-" ends the line, the rest begins the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.element_at(F.split(text, " ", -1), -1)
    cut = (F.length(last) >= least) & F.lead(F.lit(True)).over(w)
    half = F.floor(F.length(last) / 2).cast("int")
    marked = lines.withColumns({"__cut": F.coalesce(cut, F.lit(False)), "__last": last, "__half": half})
    marked = marked.withColumn("__tail", F.when(F.col("__cut"), F.col("__last").substr(F.col("__half") + 1, F.length("__last")))).withColumn("__head", F.lag("__tail").over(w))
    body = F.when(F.col("__cut"), F.concat(F.col(text).substr(F.lit(1), F.length(text) - F.length("__tail")), F.lit("-"))).otherwise(F.col(text))
    return marked.withColumn(text, F.when(F.col("__head").isNotNull(), F.concat_ws(" ", "__head", body)).otherwise(body)).drop("__cut", "__last", "__half", "__tail", "__head")
