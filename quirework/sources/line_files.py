"""Line files: one line a row, separated by tabs and compressed; and documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

HEADERS = ["doc_id", "textregion_id", "line_id", "text"]
BOXES = ["doc_box", "textregion_box", "line_box"]


def line_format(lines: DataFrame, doc: str, region: str = "region_id", *, line: str = "line_id", text: str = "text", boxes: dict[str, G.Box] | None = None) -> DataFrame:
    """doc_id, textregion_id, line_id, text and, if given, boxes as "x,y,w,h"."""
    out = [F.col(doc).cast("string").alias("doc_id"), F.col(region).cast("string").alias("textregion_id"), F.col(line).cast("string").alias("line_id"), F.col(text).alias("text")]
    return lines.select(*out, *[b.text().alias(n) for n, b in (boxes or {}).items()])


def write_lines(records: DataFrame, path: str) -> None:
    """Tab-separated, gzip; a tab, line break or backslash in a text is escaped; null is an empty field."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    # "\e" stands for an empty text
    fields = [F.when(F.col(c).isNull(), "").when(F.col(c) == "", "\\e").otherwise(safe(c)) for c in records.columns]
    records.select(F.concat_ws("\t", *fields).alias("value")).write.option("compression", "gzip").text(path)


def read_lines(spark: SparkSession, path: str, headers: list[str] = HEADERS) -> DataFrame:
    """The columns `headers` of line files; a row with fewer fields has nulls, one with more fails."""
    parts = F.split("value", "\t", -1)

    def field(i: int):
        raw = F.get(parts, F.lit(i))
        bare = F.replace(F.replace(F.replace(F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\x00")), F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\x00"), F.lit("\\"))
        return F.when(raw == "", None).when(raw == "\\e", "").otherwise(bare)

    rows = spark.read.text(path, lineSep="\n")
    ok = F.when(F.size(parts) > len(headers), F.raise_error(F.concat(F.lit("too many fields: "), F.col("value"))).cast("boolean")).otherwise(True)
    return rows.where(ok).select(*[field(i).alias(h) for i, h in enumerate(headers)])


def grouped(records: DataFrame, order: list[str], by: str = "textregion_id") -> DataFrame:
    """The lines of each document (and region) as an array in order."""
    keys = ["doc_id"] if by == "doc_id" else ["doc_id", by]
    rest = [c for c in records.columns if c not in keys and c not in order]
    return records.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, *rest))), lambda s: s).alias("lines"))


def documents(records: DataFrame, order: list[str]) -> DataFrame:
    """doc_id and regions (textregion_id and lines in order) built again from lines."""
    by_region = grouped(records, order)
    return by_region.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("textregion_id", "lines"))).alias("regions"))


def to_json(docs: DataFrame, key: str) -> DataFrame:
    """`key` and json: all other columns as one object, without nulls."""
    return docs.select(key, F.to_json(F.struct(*[c for c in docs.columns if c != key]), {"ignoreNullFields": "true"}).alias("json"))


def from_json(rows: DataFrame, key: str, schema) -> DataFrame:
    """The columns of `schema` from the objects in json; a missing field is null."""
    return rows.select(key, F.from_json("json", schema).alias("__j")).select(key, "__j.*")
