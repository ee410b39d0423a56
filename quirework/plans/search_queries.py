"""Queries over lines as running text: search, similar words, word breaks, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import running_text as R
from ..operators import search as S
from ..operators import tokens as K
from ..sources.shared import materialise
from .frames import DOC_LINES, doc_lines
from .text_queries import LINE_WORDS, WORD_TOKENS

TERM, WILD = "that", "th*"
_SQL_W = r"[\p{L}\p{N}_]"


def _hits(spark: SparkSession, sf: str, term: str) -> DataFrame:
    return S.keyword_in_context(doc_lines(spark, sf), term, keys=["doc_id", "line_no"])


def kwic(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, TERM).drop("term")


def kwic_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, WILD).select("doc_id", "line_no", "hit", "term_match", "pre", "post")


def kwic_match_freq(spark: SparkSession, sf: str) -> DataFrame:
    return S.match_frequency(_hits(spark, sf, WILD))


def _kwic_sql(term: str, tail: str) -> str:
    """Over words by number: a match begins three words before the first term that is left, or where the match before it
    ended; its term is the last one within three words from there; three words follow."""
    at = "2 * {} - (CASE WHEN tk[1] <> '' AND regexp_matches(tk[1], '^[\\p{{L}}\\p{{N}}_]') THEN 1 ELSE 0 END)".format
    return rf"""WITH RECURSIVE {DOC_LINES}, tok AS (SELECT doc_id, line_no, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS tk FROM doc_lines WHERE regexp_matches(text, '(?i){term}')),
 num AS (SELECT doc_id, line_no, tk, list_filter(tk, lambda t: regexp_matches(t, '^[\p{{L}}\p{{N}}_]')) AS wd FROM tok),
 flg AS (SELECT doc_id, line_no, tk, len(wd) AS n, list_filter(range(1, len(wd) + 1), lambda i: regexp_matches(wd[i], '(?i)^({term})$')) AS fl FROM num),
 h AS (SELECT doc_id, line_no, tk, n, fl, 0 AS hit, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS e FROM flg WHERE len(fl) > 0
   UNION ALL SELECT doc_id, line_no, tk, n, fl, hit + 1, s2, t2, least(t2 + 3, n) FROM (
     SELECT *, list_max(list_filter(fl, lambda x: x >= s2 AND x <= s2 + 3)) AS t2 FROM (
       SELECT *, greatest(e + 1, list_min(list_filter(fl, lambda x: x > e)) - 3) AS s2 FROM h WHERE len(list_filter(fl, lambda x: x > e)) > 0))),
 k AS (SELECT doc_id, line_no, CAST(hit AS INTEGER) AS hit, CAST(length(array_to_string(tk[1:{at("s")} - 1], '')) AS INTEGER) AS match_offset, tk[{at("t")}] AS term_match,
   array_to_string(tk[{at("s")}:{at("t")} - 1], '') AS pre, array_to_string(tk[{at("t")} + 1:{at("e")}], '') AS post FROM h WHERE hit > 0)
 {tail}"""


def similar_words(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar words of the whole corpus for every word of the documents whose id is divisible by 20."""
    lines = doc_lines(spark, sf)
    queries = K.word_frequency(lines.where("doc_id % 20 = 0")).select(F.col("token").alias("query"))
    return S.similar_vocabulary(K.word_frequency(lines), queries).withColumn("score", F.round("score", 6))


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    lines = R.broken_lines(doc_lines(spark, sf), ["doc_id"], "line_no")
    return R.with_words(lines)


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_words(doc_lines(spark, sf))


def mid_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    w = materialise(_words(spark, sf).select("words"), "words")  # read for the words and for the pairs
    return R.mid_bigrams(w, R.word_frequencies(w))


_FREQ = f"""{WORD_TOKENS}, freq AS (SELECT token AS word, count(*) AS "all", count(*) FILTER (WHERE pos = 0) AS start, count(*) FILTER (WHERE pos > 0 AND pos < n - 1) AS mid, count(*) FILTER (WHERE pos = n - 1) AS "end" FROM tokens GROUP BY token)"""
_BIGRAMS = f"""WITH {_FREQ}, p AS (SELECT token AS first, lead(token) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS second, pos, n FROM tokens)
SELECT first, second, count(*) AS freq FROM p JOIN freq a ON a.word = first JOIN freq b ON b.word = second WHERE pos >= 1 AND pos <= n - 4 AND a.mid >= 5 AND b.mid >= 5 GROUP BY first, second"""


def typical_line_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words that are typical of line starts and ends."""
    f = materialise(R.word_frequencies(_broken(spark, sf)), "words")
    sides = [R.typical_words(f, side).select(F.lit(side).alias("side"), "word", F.col(side).alias("freq")) for side in ("start", "end")]
    return sides[0].union(sides[1])


def broken_lines(spark: SparkSession, sf: str) -> DataFrame:
    return R.broken_lines(doc_lines(spark, sf), ["doc_id"], "line_no").select("doc_id", "line_no", "text")


BROKEN = f"""{DOC_LINES}, lw AS (SELECT *, string_split(text, ' ')[-1] AS lst, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) IS NOT NULL AS more FROM doc_lines),
 ct AS (SELECT *, CASE WHEN more AND length(lst) >= 8 THEN substr(lst, length(lst) // 2 + 1) END AS tail FROM lw),
 hd AS (SELECT *, lag(tail) OVER (PARTITION BY doc_id ORDER BY line_no) AS head FROM ct),
 broken AS (SELECT doc_id, source, lang, line_no, CASE WHEN head IS NOT NULL THEN head || ' ' ELSE '' END || CASE WHEN tail IS NOT NULL THEN left(text, length(text) - length(tail)) || '-' ELSE text END AS text FROM hd)"""


def line_word_break(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions by the break character for all pairs of lines, and how often each pair of words occurs."""
    pairs = R.line_pairs(_broken(spark, sf), ["doc_id"], ["line_no"])
    d = R.break_by_character(pairs)
    return d.where("merges").select("end_word", "start_word", "merge_word")


def word_break_model(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of the corpus model for all pairs of line ends and starts."""
    w = materialise(_broken(spark, sf).select("doc_id", "line_no", "words"), "words")
    freq = materialise(R.word_frequencies(w), "frequencies")
    cand = materialise(R.pair_candidates(R.line_pairs(w, ["doc_id"], ["line_no"]), freq), "candidates")
    return R.decide(cand, R.merge_classes(freq, R.merge_counts(cand)), R.mid_bigrams(w, freq))


def paragraph_text(spark: SparkSession, sf: str) -> DataFrame:
    return R.paragraphs(_words(spark, sf), ["doc_id"], "line_no")[0]


def line_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return R.paragraphs(_words(spark, sf), ["doc_id"], "line_no")[1]


def mended_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of lines whose words were broken on purpose: each broken word is whole again."""
    return R.paragraphs(_broken(spark, sf), ["doc_id"], "line_no")[0]


# a line that ends in "-" goes on without it unless it is the document's last line with text
_PARA = f"""{{src}}, tl AS (SELECT doc_id, line_no, text, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM {{frm}} WHERE length(text) > 0),
 sh AS (SELECT *, CASE WHEN length(text) >= 2 AND text[-1] = '-' AND text[-2] = '-' THEN left(text, length(text) - 1) ELSE text END AS s FROM tl),
 pc AS (SELECT doc_id, line_no, CASE WHEN nx IS NULL THEN text WHEN s[-1] = '-' THEN left(s, length(s) - 1) ELSE s || ' ' END AS p FROM sh),
 rg AS (SELECT doc_id, line_no, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY line_no) AS e FROM pc)"""


def _para(src: str, frm: str, tail: str) -> str:
    return "WITH " + _PARA.format(src=src, frm=frm) + tail


_TEXT = " SELECT doc_id, string_agg(p, '' ORDER BY line_no) AS paragraph FROM pc GROUP BY doc_id"

_BROKEN_WORDS = LINE_WORDS.replace("FROM doc_lines)", "FROM broken)").replace(DOC_LINES, BROKEN)
_TYPICAL = f"""WITH {_BROKEN_WORDS}, tokens AS (SELECT unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos, len(words) AS n FROM line_words),
 freq AS (SELECT token AS word, count(*) AS "all", count(*) FILTER (WHERE pos = 0) AS start, count(*) FILTER (WHERE pos = n - 1) AS "end" FROM tokens GROUP BY token)
SELECT 'start' AS side, word, start AS freq FROM freq WHERE start > 100 AND start / "all" > 0.5 UNION ALL SELECT 'end', word, "end" FROM freq WHERE "end" > 100 AND "end" / "all" > 0.5"""
_BREAKS = f"""WITH {_BROKEN_WORDS}, p AS (SELECT lag(words) OVER (PARTITION BY doc_id ORDER BY line_no) AS pw, words FROM line_words)
SELECT DISTINCT pw[-1] AS end_word, words[1] AS start_word, regexp_replace(pw[-1], '[-]{{1,2}}$', '') || regexp_replace(words[1], '^-', '') AS merge_word FROM p WHERE len(pw) > 0 AND len(words) > 0 AND pw[-1] LIKE '%-'"""

QUERIES = {
    "kwic": (kwic, _kwic_sql("that", "SELECT doc_id, line_no, hit, match_offset, term_match, pre, post, CASE WHEN length(pre) < 30 THEN lpad(pre, 30, ' ') ELSE pre END || term_match || post AS context FROM k")),
    "kwic_wildcard": (kwic_wildcard, _kwic_sql(r"th[\p{L}\p{N}_]*", "SELECT doc_id, line_no, hit, term_match, pre, post FROM k")),
    "kwic_match_freq": (kwic_match_freq, _kwic_sql(r"th[\p{L}\p{N}_]*", "SELECT term_match, count(*) AS freq FROM k GROUP BY term_match")),
    "mid_bigrams": (mid_bigrams, _BIGRAMS),
    "similar_words": (similar_words, None),
    "broken_lines": (broken_lines, f"WITH {BROKEN} SELECT doc_id, line_no, text FROM broken"),
    "typical_line_words": (typical_line_words, _TYPICAL),
    "line_word_break": (line_word_break, _BREAKS),
    "word_break_model": (word_break_model, None),
    "paragraph_text": (paragraph_text, _para(DOC_LINES, "doc_lines", _TEXT)),
    "line_ranges": (line_ranges, _para(DOC_LINES, "doc_lines", ' SELECT doc_id, line_no, CAST(e - length(p) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM rg')),
    "mended_paragraphs": (mended_paragraphs, _para(BROKEN, "broken", _TEXT)),
}
