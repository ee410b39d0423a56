"""Column expressions over line texts: tokens, word categories and histogram bins. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
ALPHA = r"^\p{L}+$"
DIGIT = r"^\p{Nd}+$"
TITLE = r"^[^\p{Lu}\p{Lt}\p{Ll}]*([\p{Lu}\p{Lt}]\p{Ll}*([^\p{Lu}\p{Lt}\p{Ll}]+|$))+$"
PUNCT = r"^[!-/:-@\[-`{-~]*$"
WORD_CATEGORIES = {"num_alpha_words": ALPHA, "num_number_words": DIGIT, "num_title_words": TITLE, "num_punctuation_words": PUNCT}
#: words a line -> name of its bin; a line beyond the last bin is in the last
LINE_BINS = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 5), (6, 9), (10, 15), (16, 25), (26, 42), (43, 70), (71, 100)]
MAX_WORD_LENGTH, LENGTH_STEP = 30, 5
_MARK = "\x01"
_W, _N, _SPACES = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]", r"[\s\p{Z}]"
# the categories for words inside a text: between spaces or its ends
_FROM, _TO = "(?<![^ ])", "(?![^ ])"
_CASED = r"\p{Lu}\p{Lt}\p{Ll}"
_IN_TEXT = {
    "num_alpha_words": r"\p{L}+",
    "num_number_words": r"\p{Nd}+",
    "num_title_words": rf"[^{_CASED} ]*(?:[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*(?:[^{_CASED} ]+|{_TO}))+",
    "num_punctuation_words": r"[!-/:-@\[-`{-~]*",
}


def space_words(text: Column) -> Column:
    """All parts between single spaces; an empty text has one empty part, a null none."""
    return F.coalesce(F.split(text, " ", -1), F.array().cast("array<string>"))


def boundary_words(text: Column) -> Column:
    """Runs of word characters and of others, without spaces and empty parts."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.replace(t, F.lit(" "), F.lit("")))
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def line_bin(n: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in reversed(LINE_BINS):
        out = F.when(n <= high, F.lit(f"{low}-{high}")).otherwise(out if (low, high) != LINE_BINS[-1] else F.lit(f"{low}-{high}"))
    return out


def word_counts(text: Column, words: Column) -> dict[str, Column]:
    """Numbers of words by category and length of a text whose `words` (their number) stand between single spaces.

    Each count is one pass of a pattern over the text; no array of words is made.
    """
    out = {"num_words": words} | {name: F.regexp_count(text, F.lit(f"{_FROM}{inner}{_TO}")) for name, inner in _IN_TEXT.items()}
    out["num_oversized_words"] = F.regexp_count(text, F.lit(f"{_FROM}[^ ]{{{MAX_WORD_LENGTH + 1},}}{_TO}"))
    for high in range(LENGTH_STEP, MAX_WORD_LENGTH + 1, LENGTH_STEP):
        out[f"num_words_length_{high}"] = F.regexp_count(text, F.lit(f"{_FROM}[^ ]{{{high - LENGTH_STEP + 1},{high}}}{_TO}"))
    return out


def let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def line_words(text: Column, break_chars: str = "-") -> Column:
    """The words of a line, break characters joined to the letters beside them; a null or empty line has none.

    A break character that is doubled, or set off by a space, at the end of the line loses the doubling or the space.
    Marks go around the tokens between words and are taken out again by replacements over the whole line; those for
    break characters are made in lines that have some.
    """
    marks = "".join("\\" + c for c in break_chars)
    any_of = lambda t, before, after: reduce(Column.__or__, [F.contains(t, F.lit(before + c + after)) for c in break_chars])
    ends = F.substring(text, -1, 1).isin(list(break_chars))
    tail = F.when(ends, F.regexp_replace(text, rf"(?<=[{marks}])[{marks}]\z| (?=[{marks}]\z)", "")).otherwise(text)

    def split_lead(t: Column) -> Column:
        return let(F.regexp_extract(t, rf"^{_N}*", 0), lambda lead: words(lead, t.substr(F.length(lead) + 1, F.length(t))))

    def words(lead: Column, rest: Column) -> Column:
        # a first token without letters stays as it is
        joins = (lead == "") | (F.substring(lead, -1, 1).isin(list(break_chars)) & rest.rlike(r"^\p{L}"))
        whole = F.when(rest == "", lead).otherwise(F.concat(lead, F.when(joins, "").otherwise(_MARK), marked(rest)))
        return F.split(whole, _MARK, -1)

    def marked(rest: Column) -> Column:
        out = F.regexp_replace(rest, f"({_N}+)", f"{_MARK}$1{_MARK}")
        out = let(out, lambda t: F.when(any_of(t, _MARK, ""), F.regexp_replace(t, rf"(?<!{_W})(\p{{L}}{_W}*){_MARK}(?=[{marks}])", "$1")).otherwise(t))
        out = let(out, lambda t: F.when(any_of(t, "", _MARK), F.regexp_replace(t, rf"([{marks}]){_MARK}(?=\p{{L}})", "$1")).otherwise(t))
        out = let(F.replace(out, F.lit(f"{_MARK} {_MARK}"), F.lit(_MARK)), lambda t: F.when(F.endswith(t, F.lit(_MARK)), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))
        return F.regexp_replace(out, rf"(?<={_MARK}){_SPACES}+|{_SPACES}+(?={_MARK}|\z)", "")

    found = let(F.replace(tail, F.lit(_MARK), F.lit(" ")), split_lead)
    none = F.array().cast("array<string>")
    # never null, so that no filter for nulls makes the words again
    return F.when(text.isNull() | (text == ""), none).otherwise(F.coalesce(found, none))


def without_break(end: Column, start: Column, break_chars: str = "-=:") -> Column:
    """End and start of a broken word joined without the break characters between them."""
    marks = "".join("\\" + c for c in break_chars)
    return F.concat(F.regexp_replace(end, f"[{marks}]{{1,2}}$", ""), F.regexp_replace(start, f"^[{marks}]", ""))


def without_hyphen(word: Column) -> Column:
    """A word without the hyphen, double hyphen, '=' or ':' at its end."""
    return F.regexp_replace(word, "(--|[-=:])$", "")
