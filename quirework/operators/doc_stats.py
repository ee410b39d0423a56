"""Features of documents: counts of lines, words and word categories, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WIDTHS = list(range(300, 3000, 300))


def width_ranges(bounds: list) -> list[str]:
    starts = [0, *bounds]
    return [f"{a}-{b}" for a, b in zip(starts, bounds)] + [f"{starts[-1]}-"]


def width_range(width: Column, bounds: list) -> Column:
    """Name of the range that a width falls into; an upper bound is outside."""
    out = F.lit(width_ranges(bounds)[-1])
    for name, bound in reversed(list(zip(width_ranges(bounds), bounds))):
        out = F.when(width < bound, F.lit(name)).otherwise(out)
    return out


def equal_bounds(width: float, parts: int = 5) -> list[float]:
    """Bounds of equal parts of a width."""
    return [width / parts * k for k in range(1, parts)]


def line_features(lines: DataFrame, *, text: str = "text", width: str | None = None, stop_words: list[str] | None = None, bounds: list = WIDTHS, boundaries: bool = False) -> DataFrame:
    """The counts of `doc_stats` for each line, beside the line's columns."""
    out = lines.where(F.col(text).isNotNull())
    if boundaries:  # the words as a text again, for one kind of counting
        words = T.boundary_words(F.col(text))
        out = out.withColumn("__w", words).withColumns({"__t": F.array_join("__w", " "), "__n": F.size("__w")}).drop("__w")
    else:
        out = out.withColumns({"__t": F.col(text), "__n": F.regexp_count(text, F.lit(" ")) + 1})
    cols = {n: F.when(F.col("__n") > 0, c).otherwise(0) for n, c in T.word_counts(F.col("__t"), F.col("__n")).items()}
    stops = F.size(F.filter(F.split("__t", " ", -1), lambda x: x.isin(stop_words))) if stop_words is not None else F.lit(None).cast("int")
    line = F.col(text)
    # counted once: a bin asks for its number again and again
    cols |= {"num_stop_words": stops, "__filled": F.regexp_count(line, F.lit("[^ ]+")), "__alpha": T.word_counts(line, F.lit(0))["num_alpha_words"]}
    out = out.withColumns(cols).withColumn("num_non_title_words", F.col("num_words") - F.col("num_title_words"))
    out = out.withColumns({"__wpl": T.line_bin(F.col("__filled")), "__awpl": T.line_bin(F.col("__alpha"))})
    for low, high in T.LINE_BINS:
        name = f"{low}-{high}"
        out = out.withColumns({f"words_per_line_{name}": (F.col("__wpl") == name).cast("int"), f"alpha_words_per_line_{name}": (F.col("__awpl") == name).cast("int")})
    if width:
        rng = width_range(F.col(width), bounds)
        out = out.withColumns({f"line_width_range_{r}": (rng == r).cast("int") for r in width_ranges(bounds)})
    return out.drop("__t", "__n", "__filled", "__alpha", "__wpl", "__awpl")


def doc_stats(lines: DataFrame, keys: list[str], **options) -> DataFrame:
    """One row for each document: number of lines and the sums of all features of its lines.

    Only partial sums are shuffled, by the document's key.
    """
    features = line_features(lines, **options)
    names = [c for c in features.columns if c not in lines.columns]
    return features.groupBy(*keys).agg(F.count("*").alias("lines"), *[F.sum(n).alias(n) for n in names])
