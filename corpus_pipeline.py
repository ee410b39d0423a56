"""The corpus pipeline: documents pass the operators of `quirework.llm` one after another.

The documents have the columns doc_id, text, lang, source and, if given, n_chars, beside any others. Each stage handles
nulls, empty and long texts, ties, repeated rows, empty tables and extra columns as its operator's module says. All
stages but the last return the columns of the documents they get. A stage's result is written before the next stage
begins, which then deletes the tables that the one before it used.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import bpe, language_id, line_dedup, mixing, simhash
from quirework.llm._common import materialise, recorded, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents of the table make known; the others go."""
    return language_id.keep_accepted(docs, language_id.train(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated passages; those that were nothing else go."""
    return line_dedup.drop_repeated_runs(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, and all others.

    Of a later near copy line dedup has left the edited words alone, which are like nothing; so documents are compared by
    their texts before that, too, where they are what is left of these.
    """
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if {"doc_id", "text"} <= set(before.columns):
        docs = materialise(simhash.drop_copies_before_edit(docs, before), "compared")
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources have flattened shares; every document occurs once at least."""
    counts = mixing.source_counts(docs)
    weights = mixing.flattened_weights(counts)
    decided = mixing.copies(docs, weights, mixing.total_without_loss(counts, weights), counts=counts)
    return mixing.repeat_rows(docs, decided)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each text, decoded again as a check."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


_used: list[str] = []


def _tidy(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _used)
        with recorded(_used):
            return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _tidy(identify_language)),
    ("line_dedup", _tidy(drop_repeated_lines)),
    ("simhash_near_dedup", _tidy(drop_near_duplicates)),
    ("source_mixing", _tidy(mix_sources)),
    ("byte_bpe", _tidy(encode_text)),
]

#: the stages' hashes, vectors and merges can't be put in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
