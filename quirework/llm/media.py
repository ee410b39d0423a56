"""Media columns: a data source over ZIP archives that reads members by byte ranges.

Planning looks at the archives' sizes only: a partition is a byte range of one archive. Its task reads the archive's
central directory and takes the members that begin in the range; a member isn't divided. It streams them: payloads leave
as Arrow batches of `batchBytes` at most (or one member), so a task's memory doesn't grow with its range. Each member is
read on its own by its offset and checked against its CRC; if that fails, or the file can't be opened, it alone is read
again, up to `retries` times, from a newly opened file. With `mode` permissive a member that fails for good yields a row
with null payload and its error, else the task fails.

Defined results: an empty member has an empty payload; folders are no members; an archive without members, or a folder
without archives, gives no row; members of one name are a row each, in each archive; names are as they stand in the
archive; a payload is held whole (2 GB at most, as in any binary column). In writing, rows without a name or a payload
are left out, rows that repeat are members each, and other columns, by any name, are passed over; writing to a folder
that has archives adds to them.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ._common import partitions_for, scratch
from ._files import base_name, create, listed, move, open_input, resolve

SCHEMA = "archive string, member string, offset long, compressed_bytes long, n_bytes long, media_type string, payload binary, error string"
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
MEMBERS_PER_ARCHIVE = 10_000
_TYPES = {"html": "text/html", "txt": "text/plain", "json": "application/json", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "wav": "audio/wav", "mp3": "audio/mpeg", "flac": "audio/flac", "mp4": "video/mp4", "webm": "video/webm", "pdf": "application/pdf"}


@dataclass
class Member:
    name: str
    offset: int
    compressed: int
    size: int
    method: int
    crc: int


@dataclass
class Range(InputPartition):
    """The members of an archive that begin at `start` or after it and before `stop`."""

    path: str
    start: int
    stop: int


def directory(f: io.BufferedIOBase) -> list[Member]:
    """The members of a ZIP archive by offset, from its central directory."""
    with zipfile.ZipFile(f) as z:
        found = [Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir()]
    return sorted(found, key=lambda m: m.offset)


def read_member(f: io.BufferedIOBase, m: Member) -> bytes:
    """A member's payload, read by its offset and checked."""
    f.seek(m.offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise OSError(f"no member at {m.offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(m.offset + 30 + name + extra)
    raw = f.read(m.compressed)
    if len(raw) != m.compressed:
        raise OSError(f"{m.name} ends early")
    if m.method == zipfile.ZIP_STORED:
        data = raw
    elif m.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(raw, -15)
    else:
        raise OSError(f"{m.name}: compression {m.method} isn't known")
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise OSError(f"{m.name}: wrong checksum")
    return data


class MediaSource(DataSource):
    """format("media_zip"): options path (a folder of .zip files, a path or URI), rangeBytes, batchBytes,
    retries, mode (failfast or permissive)."""

    @classmethod
    def name(cls) -> str:
        return "media_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[InputPartition]:
        step = self.range_bytes
        return [Range(path, a, a + step) for path, size in listed(self.path, ".zip") for a in range(0, size, step)] or [Range("", 0, 0)]

    def open(self, path: str):
        return open_input(path)

    def again(self, path: str, act):
        """(act(file), null, file), or (null, the error, null) if that fails `retries` times more; each time the file is opened anew."""
        error = None
        for _ in range(self.retries + 1):
            try:
                f = self.open(path)
                return act(f), None, f
            except (OSError, zlib.error, zipfile.BadZipFile) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error, None

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        found, error, f = self.again(partition.path, directory)
        if error:
            raise OSError(f"{partition.path}, after {self.retries} retries: {error}")
        rows: list[tuple] = []
        held = 0
        for m in found:
            if not partition.start <= m.offset < partition.stop:
                continue
            data = error = None
            try:
                data = read_member(f, m) if f else None
            except (OSError, zlib.error):
                f = None
            if f is None:
                data, error, f = self.again(partition.path, lambda g: read_member(g, m))
            if error and not self.permissive:
                raise OSError(f"{partition.path}, {m.name}, after {self.retries} retries: {error}")
            rows.append((m, data, error))
            held += m.size
            if held >= self.batch_bytes or len(rows) >= 10_000:
                yield _batch(partition.path, rows)
                rows, held = [], 0
        if rows:
            yield _batch(partition.path, rows)


def _batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    m = [r[0] for r in rows]
    kinds = [_TYPES.get(x.name.rpartition(".")[2].lower(), "application/octet-stream") for x in m]
    cols = [
        pa.array([base_name(path)] * len(m)),
        pa.array([x.name for x in m]),
        pa.array([x.offset for x in m], pa.int64()),
        pa.array([x.compressed for x in m], pa.int64()),
        pa.array([x.size for x in m], pa.int64()),
        pa.array(kinds),
        pa.array([r[1] for r in rows], pa.binary()),
        pa.array([r[2] for r in rows], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_zip").option("path", path).options(**options).load()


def write_archives(df: DataFrame, path: str, *, name_col: str, payload_col: str, archives: int) -> None:
    """ZIP archives with one member for each row that has a name and a payload; files appear whole, or not at all.

    Payloads aren't shuffled: a partition of `df` makes an archive, at most `archives` of them. Names carry the write's
    id, so that another write to the folder touches none of these.
    """
    folder, write_id = path.rstrip("/"), uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}-{write_id}"
        temporary = f"{folder}/_{name}-{uuid.uuid4().hex}"
        n, out, z = 0, None, None
        for b in batches:
            for member, payload in zip(b.column(0).to_pylist(), b.column(1)):
                if z is None:
                    out = create(temporary)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(member), payload.as_buffer().to_pybytes(), zipfile.ZIP_DEFLATED)
                n += 1
        if z is not None:  # a task that runs again replaces the file by an equal one
            z.close()
            out.close()
            move(temporary, f"{folder}/{name}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = df.where(F.col(name_col).isNotNull() & F.col(payload_col).isNotNull()).select(F.col(name_col).cast("string").alias("name"), F.col(payload_col).cast("binary").alias("payload"))
    rows.coalesce(archives).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    fs, root = resolve(folder)
    for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):  # of tasks that failed
        if f.base_name.startswith("_part-") and f"-{write_id}-" in f.base_name:
            fs.delete_file(f.path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, put into archives and read back as a media column."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark, "media")
    named = pages.select(F.concat("page_id", F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("payload"))
    write_archives(named, path, name_col="name", payload_col="payload", archives=partitions_for(pages.count(), MEMBERS_PER_ARCHIVE))
    media = read(spark, path)
    return media.select("member", "media_type", "n_bytes", F.md5("payload").alias("md5"), F.decode("payload", "UTF-8").alias("content"))


ORACLE = """SELECT page_id || '.html' AS member, 'text/html' AS media_type, octet_length(encode(html)) AS n_bytes, md5(html) AS md5, html AS content
FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL"""
QUERY = ("op10_media_columns", query)
