"""WARC archives: a data source that reads and writes them, and the resolution of revisit records.

Resolution shuffles headers only, by payload digest: the earliest response with a payload is the digest's original (by
date, then record id, nulls last); every other response with that digest and every revisit record becomes a revisit of
the original, which is named in its fresh headers; a revisit whose digest has no response is kept and stays unresolved.
Payloads are joined back to the originals alone and written to gzip archives, one member for each record and one archive
for each partition of the shuffle.

Defined results: a record without a digest gets the digest of its payload, and one without a payload, too, is unresolved
unless it is a response, which then is an original with an empty payload of its own; equal records are each kept, all
but one as revisits; a payload may be long, a record is held whole (2 GB at most, as in any binary column); an empty
table gives no archive; columns other than those named, by any name, are passed over. Writing to a folder that has
archives adds to them.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ._common import bitmap_words, likely, materialise, scratch
from ._files import base_name, create, listed, move, open_input, remove, resolve

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, refers_to_date string, payload binary"
READ_SCHEMA = SCHEMA + ", archive string, offset long, length long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "refers_to_date": "WARC-Refers-To-Date"}


def record_bytes(row) -> bytes:
    """One record with fresh headers: its length, type and references are those of what is written."""
    payload = b"" if row.payload is None else bytes(row.payload)
    lines = ["WARC/1.1"]
    for field, name in _NAMES.items():
        value = getattr(row, field)
        if value is not None:
            value = " ".join(value.split())  # a header is one line
            lines.append(f"{name}: <{value}>" if field in ("record_id", "refers_to") else f"{name}: {value}")
    if row.warc_type == "revisit":
        lines.append(f"WARC-Profile: {_PROFILE}")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    given = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        given[name.strip().lower()] = value.strip()
    out = {f: given.get(n.lower()) for f, n in _NAMES.items()}
    for f in ("record_id", "refers_to"):
        if out[f]:
            out[f] = out[f].strip("<>")
    out["payload"] = rest[: int(given.get("content-length", 0))]
    return out


@dataclass
class _Archive(InputPartition):
    path: str


class WarcSource(DataSource):
    """format("warc"): option path is a folder of .warc.gz files, a path or URI; headersOnly leaves payloads out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.headers_only = options.get("headersonly", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Archive(path) for path, _ in listed(self.path, ".warc.gz")] or [_Archive("")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = [*_NAMES, "payload", "archive", "offset", "length"]
        rows: list[dict] = []
        held = 0
        types = {"payload": pa.binary(), "offset": pa.int64(), "length": pa.int64()}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)

        for offset, length, data in gzip_members(partition.path):
            r = parse_record(data) | {"archive": base_name(partition.path), "offset": offset, "length": length}
            if self.headers_only:
                r["payload"] = None
            held += len(r["payload"] or b"")
            rows.append(r)
            if held > 8 << 20 or len(rows) >= 10_000:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


def gzip_members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each member of a gzip file."""
    with open_input(path) as f:
        at, rest = 0, b""
        while True:
            d = zlib.decompressobj(31)
            out, used = [], 0
            while not d.eof:
                chunk = rest or f.read(1 << 20)
                rest = b""
                if not chunk:
                    if used:
                        raise EOFError(f"{path} ends within a member")
                    return
                used += len(chunk)
                out.append(d.decompress(chunk))
            rest = d.unused_data
            used -= len(rest)
            yield at, used, b"".join(out)
            at += used


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceWriter):
    """Each task writes a file of its own name; the files get their names when the job commits, so that tasks that run
    again, or twice, leave nothing behind. Names carry the write's id: another write, also at the same time, to the same
    folder adds files and touches none of these."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.id = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}-{self.id}"
        temporary = f"{self.path}/_{name}-{uuid.uuid4().hex}"
        f = None
        for row in rows:
            f = f or create(temporary)
            f.write(gzip.compress(record_bytes(row), 6, mtime=0))
        if f is None:
            return _Written("", "")
        f.close()
        return _Written(temporary, f"{self.path}/{name}.warc.gz")

    def commit(self, messages: list) -> None:
        for m in messages:
            if m and m.temporary:
                move(m.temporary, m.final)
        self._clear()

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.temporary:
                remove(m.temporary)
        self._clear()

    def _clear(self) -> None:
        """What tasks of this write left that failed or ran twice."""
        fs, root = resolve(self.path)
        for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith("_part-") and f"-{self.id}-" in f.base_name:
                fs.delete_file(f.path)


def resolve_headers(records: DataFrame) -> DataFrame:
    """Fresh headers of all records (columns of SCHEMA but payload), and `resolution`: original, duplicate, revisit or
    unresolved. Only headers are shuffled."""
    digest = F.coalesce("payload_digest", F.when(F.col("payload").isNotNull(), F.concat(F.lit("sha1:"), F.sha1("payload"))))
    heads = records.select("record_id", "warc_type", "target_uri", "warc_date", digest.alias("payload_digest"), F.col("payload").isNull().alias("__empty"))
    is_response = F.coalesce(F.col("warc_type") != "revisit", F.lit(True))
    # a response with a payload comes before all without
    first = F.struct(F.col("__empty").alias("e"), F.col("warc_date").isNull().alias("dn"), F.col("warc_date").alias("d"), F.col("record_id").isNull().alias("n"), F.col("record_id").alias("id"))
    originals = heads.where(F.col("payload_digest").isNotNull() & is_response).groupBy(F.col("payload_digest").alias("digest")).agg(F.min(first).alias("o"))
    joined = heads.join(originals, heads.payload_digest == originals.digest, "left")
    same = F.col("o.id").eqNullSafe(F.col("record_id")) & F.col("o.d").eqNullSafe(F.col("warc_date")) & (F.col("o.e") == F.col("__empty")) & is_response & F.col("o").isNotNull()
    # of equal records one is the original
    turn = F.row_number().over(Window.partitionBy("digest", "record_id", "warc_date", same).orderBy(F.lit(1)))
    joined = joined.withColumn("__same", same).withColumn("__turn", F.when(same, turn).otherwise(0))
    lone = is_response & F.col("payload_digest").isNull()
    resolution = F.when((F.col("__same") & (F.col("__turn") == 1)) | lone, "original").when(F.col("o").isNull(), "unresolved").when(is_response, "duplicate").otherwise("revisit")
    out = joined.withColumn("resolution", resolution)
    points = F.col("resolution").isin("duplicate", "revisit")
    return out.select(
        "record_id",
        F.when(F.col("resolution") == "original", F.coalesce("warc_type", F.lit("response"))).otherwise("revisit").alias("warc_type"),
        "target_uri",
        "warc_date",
        "payload_digest",
        F.when(points, F.col("o.id")).alias("refers_to"),
        F.when(points, F.col("o.d")).alias("refers_to_date"),
        "resolution",
    )


def write_resolved(records: DataFrame, path: str) -> DataFrame:
    """Resolve `records` (columns of SCHEMA), write the archives to `path` and return the fresh headers."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    heads = materialise(resolve_headers(records), "headers")
    payloads = records.where(F.col("payload").isNotNull() & F.coalesce(F.col("warc_type") != "revisit", F.lit(True)))
    key = lambda: F.concat_ws("|", *[F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in ("record_id", "warc_date", "payload_digest")])
    payloads = payloads.withColumn("payload_digest", F.coalesce("payload_digest", F.concat(F.lit("sha1:"), F.sha1("payload")))).select(key().alias("p_key"), "payload")
    # payloads that no original has are left where they are, as far as a bitmap of bounded size can tell
    original = (F.col("resolution") == "original") & F.col("payload_digest").isNotNull()
    hashes = lambda k: (F.xxhash64(k), F.xxhash64(F.lit(1), k))
    k, k2 = hashes(key())
    wanted = materialise(heads.where(original).select(k.alias("k"), k2.alias("k2")).distinct(), "originals")
    payloads = likely(payloads, wanted, hashes(F.col("p_key")), bitmap_words(wanted.count())).where("__qw_likely").drop("__qw_likely")
    # the others are shuffled once: the join, the choice among equal records and the archives share a partitioning; the
    # keys of records without a payload meet none. A digest has one original, so only its key's rows are chosen among:
    # responses without a digest are each kept
    keyed = heads.withColumn("p_key", F.when(original, key()).otherwise(F.concat(F.lit("/"), key())))
    turn = F.row_number().over(Window.partitionBy("p_key").orderBy(F.xxhash64("payload")))
    full = keyed.join(payloads, "p_key", "left").withColumn("__n", turn).where(~original | (F.col("__n") == 1))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    full.select(names).sortWithinPartitions("warc_date", "record_id").write.format("warc").mode("append").option("path", path).save()
    return heads


def crawl(pages: DataFrame) -> DataFrame:
    """Two crawls of `pages` as WARC records: the first responds in full; in the second a page with an even id is a
    revisit record without payload, any other a full response again."""
    stem = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    body = F.encode(F.col("html"), "UTF-8")
    digest = F.concat(F.lit("sha1:"), F.sha1(body))
    first = pages.select(F.concat(F.lit("urn:page:1:"), stem).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), digest.alias("payload_digest"), body.alias("payload"))
    even = F.coalesce(F.col("page_id") % 2 == 0, F.lit(False))
    second = pages.select(F.concat(F.lit("urn:page:2:"), stem).alias("record_id"), F.when(even, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"), F.lit("2024-02-01T00:00:00Z").alias("warc_date"), digest.alias("payload_digest"), F.when(~even, body).alias("payload"))
    null = F.lit(None).cast("string")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return first.union(second).withColumns({"refers_to": null, "refers_to_date": null}).select(names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of two crawls of all pages, resolved, written and read again: every record's fresh headers and size."""
    path = scratch(spark, "warc")
    write_resolved(crawl(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    back = spark.read.format("warc").option("path", path).load()
    return back.select("record_id", "warc_type", "target_uri", "warc_date", "payload_digest", "refers_to", "refers_to_date", F.length("payload").cast("long").alias("payload_bytes"), F.when(F.length("payload") > 0, F.sha1("payload")).alias("payload_sha1"))


ORACLE = """WITH c AS (
  SELECT 'urn:page:1:' || page_id AS record_id, url, '2024-01-01T00:00:00Z' AS warc_date, html, TRUE AS response FROM pages
  UNION ALL SELECT 'urn:page:2:' || page_id, url, '2024-02-01T00:00:00Z', html, page_id % 2 <> 0 FROM pages),
 o AS (SELECT *, first_value(record_id) OVER w AS oid, first_value(warc_date) OVER w AS od FROM c
       WINDOW w AS (PARTITION BY html ORDER BY NOT response, warc_date, record_id))
SELECT record_id, CASE WHEN record_id = oid THEN 'response' ELSE 'revisit' END AS warc_type, url AS target_uri, warc_date, 'sha1:' || sha1(html) AS payload_digest,
  CASE WHEN record_id <> oid THEN oid END AS refers_to, CASE WHEN record_id <> oid THEN od END AS refers_to_date,
  CAST(CASE WHEN record_id = oid THEN octet_length(encode(html)) ELSE 0 END AS BIGINT) AS payload_bytes,
  CASE WHEN record_id = oid AND html <> '' THEN sha1(html) END AS payload_sha1
FROM o"""
QUERY = ("op2_warc_revisits", query)
