"""Queries over texts: document features, token statistics, keyness, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import doc_stats as D
from ..operators import tokens as K
from .frames import DOC_LINES, doc_lines, table

STOP_WORDS = ["the", "of", "and", "de", "la", "der", "die", "und", "le", "en"]
#: a line's width in pixels stands for 20 times its characters
_WIDTH = 20


def _features(spark: SparkSession, sf: str, stop_words=None) -> DataFrame:
    lines = doc_lines(spark, sf).withColumn("width", F.length("text") * _WIDTH)
    return D.doc_stats(lines, ["doc_id"], width="width", stop_words=stop_words)


def _sql_count(words: str, pattern: str) -> str:
    return f"len(list_filter({words}, lambda x: regexp_matches(x, '{pattern}')))"


def _sql_bin(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {b} THEN '{a}-{b}'" for a, b in T.LINE_BINS) + f" ELSE '{T.LINE_BINS[-1][0]}-{T.LINE_BINS[-1][1]}' END"


def _sql_features() -> dict[str, str]:
    cols = {"num_words": "len(w)"} | {n: _sql_count("w", p) for n, p in T.WORD_CATEGORIES.items()}
    cols["num_non_title_words"] = f"len(w) - {cols['num_title_words']}"
    cols["num_stop_words"] = f"len(list_filter(w, lambda x: list_contains({STOP_WORDS}, x)))"
    cols["num_oversized_words"] = f"len(list_filter(w, lambda x: length(x) > {T.MAX_WORD_LENGTH}))"
    for high in range(T.LENGTH_STEP, T.MAX_WORD_LENGTH + 1, T.LENGTH_STEP):
        cols[f"num_words_length_{high}"] = f"len(list_filter(w, lambda x: length(x) > {high - T.LENGTH_STEP} AND length(x) <= {high}))"
    for a, b in T.LINE_BINS:
        cols[f"words_per_line_{a}-{b}"] = f"CAST(wpl = '{a}-{b}' AS INTEGER)"
        cols[f"alpha_words_per_line_{a}-{b}"] = f"CAST(awpl = '{a}-{b}' AS INTEGER)"
    starts = [0, *D.WIDTHS]
    for a, name in zip(starts, D.width_ranges(D.WIDTHS)):
        upper = f" AND width < {a + 300}" if not name.endswith("-") else ""
        cols[f"line_width_range_{name}"] = f"CAST(width >= {a}{upper} AS INTEGER)"
    return cols


_LINE = f"""{DOC_LINES}, l AS (SELECT *, string_split(text, ' ') AS w, {_WIDTH} * length(text) AS width FROM doc_lines),
 f AS (SELECT *, {_sql_bin("len(list_filter(w, lambda x: x <> ''))")} AS wpl, {_sql_bin(_sql_count("list_filter(w, lambda x: x <> '')", T.ALPHA))} AS awpl FROM l)"""
_ALL = _sql_features()


def _sql_stats(names: list[str], key: str = "doc_id") -> str:
    cols = [f'CAST(sum({_ALL[n]}) AS BIGINT) AS "{n}"' for n in names]
    return f"WITH {_LINE} SELECT {key}, CAST(count(*) AS BIGINT) AS lines, {', '.join(cols)} FROM f GROUP BY {key}"


STATS = [n for n in _ALL if n != "num_stop_words"]
CATEGORIES = ["num_words", *T.WORD_CATEGORIES, "num_non_title_words"]
LENGTHS = ["num_oversized_words", *[n for n in _ALL if n.startswith("num_words_length_")]]


def _pick(names: list[str], stop_words=None):
    return lambda spark, sf: _features(spark, sf, stop_words).select("doc_id", "lines", *[f"`{n}`" for n in names])


def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return D.doc_stats(doc_lines(spark, sf).withColumn("corpus", F.lit("all")), ["corpus"]).select("corpus", "lines", *CATEGORIES)


def boundary_word_stats(spark: SparkSession, sf: str) -> DataFrame:
    return D.doc_stats(doc_lines(spark, sf), ["doc_id"], boundaries=True).select("doc_id", "num_words", *T.WORD_CATEGORIES)


_BOUNDARY = f"list_filter(list_transform(regexp_extract_all(text, '{T.TOKEN}'), lambda t: replace(t, ' ', '')), lambda t: t <> '')"
_BOUNDARY_SQL = f"""WITH {DOC_LINES}, l AS (SELECT doc_id, {_BOUNDARY} AS w FROM doc_lines)
SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS num_words, {", ".join(f"CAST(sum({_sql_count('w', p)}) AS BIGINT) AS {n}" for n, p in T.WORD_CATEGORIES.items())} FROM l GROUP BY doc_id"""

# words of lines with break characters joined
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def line_words_sql(text: str) -> str:
    tail = f"CASE WHEN length({text}) >= 2 AND right({text}, 1) = '-' AND {text}[-2] = '-' THEN left({text}, length({text}) - 1) WHEN length({text}) >= 2 AND right({text}, 1) = '-' AND {text}[-2] = ' ' THEN left({text}, length({text}) - 2) || '-' ELSE {text} END"
    toks = f"regexp_extract_all({tail}, '{T.TOKEN}')"
    strip = _STRIP.format("t")
    piece = f"""CASE WHEN i = 1 THEN t WHEN t[1] = '-' AND regexp_matches(toks[i - 1], '^\\p{{L}}') THEN {strip}
      WHEN regexp_matches(t, '^\\p{{L}}') AND toks[i - 1][-1] = '-' THEN t WHEN t = ' ' THEN '' ELSE chr(1) || {strip} END"""
    return f"(SELECT string_split(array_to_string(list_transform(toks, lambda t, i: {piece}), ''), chr(1)) FROM (SELECT {toks} AS toks))"


LINE_WORDS = f"""{DOC_LINES}, line_words AS (SELECT doc_id, source, lang, line_no, text, CASE WHEN length(text) > 0 THEN string_split(array_to_string(list_transform(toks, lambda t, i:
    CASE WHEN i = 1 THEN t WHEN t[1] = '-' AND regexp_matches(toks[i - 1], '^\\p{{L}}') THEN {_STRIP.format("t")}
      WHEN regexp_matches(t, '^\\p{{L}}') AND toks[i - 1][-1] = '-' THEN t WHEN t = ' ' THEN '' ELSE chr(1) || {_STRIP.format("t")} END), ''), chr(1)) ELSE [] END AS words
  FROM (SELECT *, regexp_extract_all(CASE WHEN length(text) >= 2 AND text[-1] = '-' AND text[-2] = '-' THEN left(text, length(text) - 1)
      WHEN length(text) >= 2 AND text[-1] = '-' AND text[-2] = ' ' THEN left(text, length(text) - 2) || '-' ELSE text END, '{T.TOKEN}') AS toks FROM doc_lines))"""
WORD_TOKENS = f"{LINE_WORDS}, tokens AS (SELECT doc_id, source, lang, line_no, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos, len(words) AS n FROM line_words)"
CHAR_TOKENS = f"{DOC_LINES}, tokens AS (SELECT doc_id, source, lang, line_no, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, length(text) AS n FROM doc_lines WHERE length(text) > 0)"


def _freq_sql(char: bool, where: str = "") -> str:
    end = "pos = n - 1 AND n > 1" if char else "pos = n - 1"
    return f"SELECT token, count(*) AS all_freq, count(*) FILTER (WHERE pos = 0) AS start_freq, count(*) FILTER (WHERE pos > 0 AND pos < n - 1) AS mid_freq, count(*) FILTER (WHERE {end}) AS end_freq FROM tokens {where} GROUP BY token"


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _positions(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _round(K.position_fractions(K.position_frequencies(K.line_tokens(doc_lines(spark, sf), kind), kind)))

    return query


def _positions_sql(char: bool) -> str:
    fr = {p: f"{p}_freq / nullif(sum({p}_freq) OVER (), 0)" for p in K.POSITIONS}
    cols = [f"round({fr[p]}, 6) AS {p}_frac" for p in K.POSITIONS] + [f"round(({fr[p]}) / nullif({fr['all']}, 0), 6) AS {p}_rel_frac" for p in K.POSITIONS[1:]]
    return f"WITH {CHAR_TOKENS if char else WORD_TOKENS}, q AS ({_freq_sql(char)}) SELECT *, {', '.join(cols)} FROM q"


def position_totals(spark: SparkSession, sf: str) -> DataFrame:
    return K.position_totals(K.position_frequencies(K.line_tokens(doc_lines(spark, sf), "word"), "word"))


_TOTALS_SQL = f"WITH {WORD_TOKENS}, q AS ({_freq_sql(False)}) " + " UNION ALL ".join(
    f"SELECT '{p}' AS position, count(*) FILTER (WHERE {p}_freq > 0) AS num_types, CAST(sum({p}_freq) AS BIGINT) AS num_tokens FROM q" for p in K.POSITIONS
)


def merged_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """The merged analyses of all languages of the table and of the documents without one."""
    each = K.position_frequencies(K.line_tokens(doc_lines(spark, sf), "word", keys=["lang"], ignorecase=True), "word", keys=["lang"])
    return K.merge_analyses(each)


_MERGED_SQL = f"WITH {WORD_TOKENS.replace('FROM documents)', chr(70) + 'ROM (SELECT * REPLACE (lower(text) AS text) FROM documents))')} {_freq_sql(False)}"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return doc_lines(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def keyness_quality(spark: SparkSession, sf: str) -> DataFrame:
    lines = _labelled(spark, sf)
    return _round(K.keyness(K.word_frequency(lines.where("quality = 1")), K.word_frequency(lines.where("quality = 0"))), 4)


def keyness_language(spark: SparkSession, sf: str) -> DataFrame:
    lines = doc_lines(spark, sf)
    return _round(K.keyness(K.word_frequency(lines.where("lang = 'fr'")), K.word_frequency(lines.where("lang = 'es'"))), 4)


def complement_keyness(spark: SparkSession, sf: str) -> DataFrame:
    lines = doc_lines(spark, sf)
    return _round(K.complement_keyness(K.word_frequency(lines), K.word_frequency(lines.where("source = 'src0'"))), 4)


_WORDS_SQL = r"unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"


def _keyness_sql(target: str, reference: str) -> str:
    def term(o: str, e: str) -> str:
        return f"{o} * ln(({o} + 1e-20) / ({e} + 1e-20))"

    return f"""WITH {DOC_LINES}, lab AS (SELECT l.*, quality FROM doc_lines l LEFT JOIN labels USING (doc_id)),
 wt AS (SELECT {_WORDS_SQL} AS token FROM lab WHERE {target}), wr AS (SELECT {_WORDS_SQL} AS token FROM lab WHERE {reference}),
 t AS (SELECT token, count(*) AS f FROM wt GROUP BY token), r AS (SELECT token, count(*) AS f FROM wr GROUP BY token),
 b AS (SELECT token, coalesce(t.f, 0) AS target_freq, coalesce(r.f, 0) AS reference_freq, (SELECT count(*) FROM wt) AS tn, (SELECT count(*) FROM wr) AS rn FROM t FULL JOIN r USING (token)),
 e AS (SELECT *, (target_freq + reference_freq)::DOUBLE * tn / (tn + rn) AS ea, (target_freq + reference_freq)::DOUBLE * rn / (tn + rn) AS eb,
   (tn + rn - target_freq - reference_freq)::DOUBLE * tn / (tn + rn) AS ec, (tn + rn - target_freq - reference_freq)::DOUBLE * rn / (tn + rn) AS ed FROM b)
SELECT token, target_freq, reference_freq, round(2 * ({term("target_freq", "ea")} + {term("reference_freq", "eb")} + {term("(tn - target_freq)", "ec")} + {term("(rn - reference_freq)", "ed")}), 4) AS log_likelihood,
 CASE WHEN target_freq > ea THEN 'more' ELSE 'less' END AS direction FROM e"""


def language_top_words(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    freq = K.word_frequency(doc_lines(spark, sf), keys=["lang"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("freq"), "token"))
    return freq.withColumn("rank", rank).where("rank <= 10")


def _vocabulary(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    return K.word_frequency(doc_lines(spark, sf).where(F.col("lang") == lang)).select("token")


def _vocabulary_sql(op: str) -> str:
    side = lambda v: f"SELECT token FROM (SELECT {_WORDS_SQL} AS token FROM doc_lines WHERE lang = '{v}')"
    return f"WITH {DOC_LINES} {side('fr')} {op} {side('es')}"


QUERIES = {
    "doc_stats": (_pick(STATS), _sql_stats(STATS)),
    "doc_word_categories": (_pick(CATEGORIES), _sql_stats(CATEGORIES)),
    "doc_stop_words": (_pick(["num_stop_words"], STOP_WORDS), _sql_stats(["num_stop_words"])),
    "word_length_bins": (_pick(LENGTHS), _sql_stats(LENGTHS)),
    "words_per_line_bins": (_pick([n for n in _ALL if n.startswith("words_per_line")]), _sql_stats([n for n in _ALL if n.startswith("words_per_line")])),
    "alpha_words_per_line_bins": (_pick([n for n in _ALL if n.startswith("alpha_words")]), _sql_stats([n for n in _ALL if n.startswith("alpha_words")])),
    "line_width_ranges": (_pick([n for n in _ALL if n.startswith("line_width")]), _sql_stats([n for n in _ALL if n.startswith("line_width")])),
    "corpus_totals": (corpus_totals, _sql_stats(CATEGORIES, "'all'").replace("SELECT 'all',", "SELECT 'all' AS corpus,").replace("GROUP BY 'all'", "")),
    "boundary_word_stats": (boundary_word_stats, _BOUNDARY_SQL),
    "char_positions": (_positions("char"), _positions_sql(True)),
    "word_positions": (_positions("word"), _positions_sql(False)),
    "position_totals": (position_totals, _TOTALS_SQL),
    "merged_analyses": (merged_analyses, _MERGED_SQL),
    "keyness_quality": (keyness_quality, _keyness_sql("quality = 1", "quality = 0")),
    "keyness_language": (keyness_language, _keyness_sql("lang = 'fr'", "lang = 'es'")),
    "complement_keyness": (complement_keyness, _keyness_sql("source = 'src0'", "source <> 'src0'")),
    "word_frequency": (lambda s, d: K.word_frequency(doc_lines(s, d)), f"WITH {DOC_LINES}, w AS (SELECT {_WORDS_SQL} AS token FROM doc_lines) SELECT token, count(*) AS freq FROM w GROUP BY token"),
    "language_top_words": (language_top_words, f"WITH {DOC_LINES}, w AS (SELECT lang, {_WORDS_SQL} AS token FROM doc_lines), c AS (SELECT lang, token, count(*) AS freq FROM w GROUP BY lang, token) SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY freq DESC, token) AS INTEGER) AS rank FROM c QUALIFY rank <= 10"),
    "vocabulary_union": (lambda s, d: _vocabulary(s, d, "fr").union(_vocabulary(s, d, "es")).distinct(), _vocabulary_sql("UNION")),
    "vocabulary_intersect": (lambda s, d: _vocabulary(s, d, "fr").intersect(_vocabulary(s, d, "es")), _vocabulary_sql("INTERSECT")),
    "vocabulary_except": (lambda s, d: _vocabulary(s, d, "fr").exceptAll(_vocabulary(s, d, "es")), _vocabulary_sql("EXCEPT")),
}
