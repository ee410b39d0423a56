"""A data source over archives of documents: zip and tar files, also compressed ones, and archives within them.

format("page_archive") with the option path (a file, or a folder in a mounted, shared place) gives one row for each
member: source_file (the archive, and the archives inside it that lead to the member), archived_filename,
archived_filepath and content. namesOnly leaves contents unread where the archive allows it. Each archive is a
partition; a large zip file is cut into several by its members.
"""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source_file array<string>, archived_filename string, archived_filepath string, content binary"
ZIP = (".zip",)
TAR = (".tar", ".tgz", ".tar.gz", ".tbz2", ".tar.bz2", ".txz", ".tar.xz")
BATCH_BYTES = 8 << 20
MEMBERS_PER_PARTITION = 5_000


def kind(name: str) -> str | None:
    """zip or tar by the name's end; null for any other file."""
    name = name.lower()
    return "zip" if name.endswith(ZIP) else "tar" if name.endswith(TAR) else None


def _zip_members(f, names_only: bool, some: range | None = None) -> Iterator[tuple[str, bytes | None]]:
    with zipfile.ZipFile(f) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        for i in infos[some.start : some.stop] if some is not None else infos:
            yield i.filename, None if names_only and kind(i.filename) is None else z.read(i)


def _tar_members(f, names_only: bool) -> Iterator[tuple[str, bytes | None]]:
    opened = tarfile.open(f) if isinstance(f, str) else tarfile.open(fileobj=f)
    with opened as t:
        for m in t:
            if m.isfile():
                yield m.name, None if names_only and kind(m.name) is None else t.extractfile(m).read()


def members(f, name: str, names_only: bool = False, chain: tuple[str, ...] = (), some: range | None = None) -> Iterator[tuple[list[str], str, str, bytes | None]]:
    """Rows of SCHEMA of an archive, a path or an open file, and of the archives in it."""
    chain = (*chain, name)
    if kind(name) is None:
        raise ValueError(f"not an archive: {name}")
    found = _zip_members(f, names_only, some) if kind(name) == "zip" else _tar_members(f, names_only)
    for path, content in found:
        if kind(path) is not None:
            yield from members(io.BytesIO(content), path, names_only, chain)
        else:
            yield list(chain), path.replace("\\", "/").rpartition("/")[2], path, content


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.names_only = options.get("namesonly", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if kind(f))
        out: list[InputPartition] = []
        for f in files:
            n = -1
            if kind(f) == "zip":
                with zipfile.ZipFile(f) as z:
                    n = sum(not i.is_dir() for i in z.infolist())
            if n > MEMBERS_PER_PARTITION:
                out += [Part(f, a, min(a + MEMBERS_PER_PARTITION, n)) for a in range(0, n, MEMBERS_PER_PARTITION)]
            else:
                out.append(Part(f, 0, -1))
        return out or [Part("", 0, -1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        types = [pa.list_(pa.string()), pa.string(), pa.string(), pa.binary()]
        rows: list[tuple] = []
        held = 0
        some = range(partition.start, partition.stop) if partition.stop >= 0 else None
        for row in members(partition.path, partition.path, self.names_only, some=some):
            rows.append(row if not self.names_only else (*row[:3], None))
            held += len(row[3] or b"")
            if held > BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows, types)
                rows, held = [], 0
        if rows:
            yield _batch(rows, types)


def _batch(rows: list[tuple], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in SCHEMA.split(", ")])


def read(spark: SparkSession, path: str, *, names_only: bool = False) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("page_archive").option("path", path).option("namesOnly", str(names_only).lower()).load()


def parse(spark: SparkSession, path: str, **options) -> DataFrame:
    """All documents of the archives; members that aren't .xml and can't be parsed are passed over."""
    from pyspark.sql import functions as F

    from . import page_xml

    found = page_xml.parse(read(spark, path), keep=("source_file", "archived_filename", "archived_filepath"), **options)
    return found.where(F.lower("archived_filename").endswith(".xml") | F.col("error").isNull())
