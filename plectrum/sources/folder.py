"""Folders of documents as a data source: ``spark.read.format("plectrum-documents").load(folder)``, or ``readStream``.

One row a file: path, name, format (by extension, else by its first bytes), size, modified_ms, reject (why it would
not be taken in) and content; with option ``content`` false the bytes are not read.  Filters on format, size, name and
path are taken by the source: a file that they exclude is never opened, unless its format hangs on its first bytes.
Files are dealt to partitions of about ``partitionBytes``, so thousands of small ones share a task and a large one has its own.

A stream takes files in the order of their time of change; its offset is the last one taken, and a file younger than ``settleMs``
waits, so that files of one moment are listed together.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql import functions as F

from plectrum.sources.formats import EXTENSIONS, MAX_DOCUMENT_BYTES, blocks_of

NAME = "plectrum-documents"
PARTITION_BYTES = 64 << 20
#: Bytes of content in a batch handed to Spark, beside one larger file.
BATCH_BYTES = 16 << 20

_FIELDS = [("path", pa.string()), ("name", pa.string()), ("format", pa.string()), ("size", pa.int64()), ("modified_ms", pa.int64()), ("reject", pa.string())]
_DDL = "path string, name string, format string, size long, modified_ms long, reject string"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified_ms: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


@dataclass
class Part(api.InputPartition):
    files: tuple[File, ...]

    def __init__(self, files: tuple[File, ...]) -> None:
        super().__init__(len(files))
        self.files = files


def format_by_name(name: str) -> str | None:
    low = name.lower()
    return next((f for f, ends in EXTENSIONS.items() if low.endswith(ends)), None)


def reject(name: str, size: int) -> str | None:
    if size == 0:
        return "empty_file"
    if size > MAX_DOCUMENT_BYTES:
        return "file_too_large"
    return None if format_by_name(name) else "unsupported_type"


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[File]:
    """The files below a folder in the order of their paths; names that begin with a dot or underscore are hidden."""
    system, inner = _system(uri)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    base = len(inner.rstrip("/")) + 1
    shown = (f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[base:].split("/")))
    return sorted((File(f.path, f.size, int((f.mtime_ns or 0) // 1_000_000)) for f in shown), key=lambda f: f.path)


def dealt(files: list[File], most: int) -> list[Part]:
    """Neighbouring files in parts of at most ``most`` bytes, or one file."""
    out, held, size = [], [], 0
    for f in files:
        if held and size + f.size > most:
            out.append(Part(tuple(held)))
            held, size = [], 0
        held.append(f)
        size += f.size
    return [*out, Part(tuple(held))] if held else out


class Test:
    """One pushed filter on a column."""

    #: For each kind of filter whether a value that is not null passes.
    KINDS = {
        api.EqualTo: lambda v, x: v == x, api.EqualNullSafe: lambda v, x: v == x, api.GreaterThan: lambda v, x: v > x,
        api.GreaterThanOrEqual: lambda v, x: v >= x, api.LessThan: lambda v, x: v < x, api.LessThanOrEqual: lambda v, x: v <= x,
        api.In: lambda v, x: v in x, api.StringStartsWith: lambda v, x: v.startswith(x), api.StringEndsWith: lambda v, x: v.endswith(x), api.StringContains: lambda v, x: x in v,
    }
    COLUMNS = ("format", "size", "name", "path")

    def __init__(self, filter_: api.Filter) -> None:
        self.column, self.kind = filter_.attribute[0], type(filter_)
        self.value = getattr(filter_, "value", None)

    @classmethod
    def of(cls, filter_: api.Filter) -> Test | None:
        known = isinstance(filter_, (*cls.KINDS, api.IsNotNull, api.IsNull)) and len(filter_.attribute) == 1 and filter_.attribute[0] in cls.COLUMNS
        return cls(filter_) if known and not (isinstance(filter_, api.EqualNullSafe) and filter_.value is None) else None

    def passes(self, value: object) -> bool:
        if self.kind in (api.IsNotNull, api.IsNull):
            return (value is None) == (self.kind is api.IsNull)
        return value is not None and bool(self.KINDS[self.kind](value, self.value))

    def __repr__(self) -> str:
        return f"{self.kind.__name__}({self.column}, {self.value})"


class _Files:
    """What the reader and the stream reader share."""

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.uri = options.get("path") or ""
        if not self.uri:
            raise ValueError("the folder is missing: load(folder) or option path")
        self.content = options.get("content", "true").lower() != "false"
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.settle_ms = int(options.get("settlems", 1000))
        self.tests: list[Test] = []

    def wanted(self, files: list[File]) -> list[File]:
        """Files that the listing does not rule out."""
        told = {"size": lambda f: f.size, "name": lambda f: f.name, "path": lambda f: f.path, "format": lambda f: format_by_name(f.name)}
        by_head = lambda f, t: t.column == "format" and format_by_name(f.name) is None
        return [f for f in files if all(by_head(f, t) or t.passes(told[t.column](f)) for t in self.tests)]

    def rows(self, files: Iterable[File]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.uri)
        fields = [*_FIELDS, ("content", pa.binary())] if self.content else _FIELDS
        held, size = [], 0
        for f in files:
            kind, data = format_by_name(f.name), None
            if self.content or kind is None:
                with system.open_input_stream(f.path) as stream:
                    head = stream.read(4)
                    kind = kind or ("pdf" if head == b"%PDF" else None)
                    if not all(t.passes(kind) for t in self.tests if t.column == "format"):
                        continue
                    data = head + stream.read() if self.content else None
            held.append((f.path, f.name, kind, f.size, f.modified_ms, reject(f.name, f.size), *([data] if self.content else [])))
            size += f.size
            if size >= BATCH_BYTES:
                yield _batch(held, fields)
                held, size = [], 0
        if held:
            yield _batch(held, fields)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


class FolderReader(api.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = _Files(options)

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:  # noqa: N802
        for f in filters:
            test = Test.of(f)
            if test is None:
                yield f
            else:
                self.files.tests.append(test)

    def partitions(self) -> list[Part]:
        return dealt(self.files.wanted(listed(self.files.uri)), self.files.most)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        yield from self.files.rows(partition.files if partition else ())


class FolderStreamReader(api.DataSourceStreamReader):
    """Offsets are the (time of change, path) of the last file taken."""

    def __init__(self, options: dict[str, str]) -> None:
        self.files = _Files(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified_ms": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        now = int(time.time() * 1000) - self.files.settle_ms
        at, path = max(((f.modified_ms, f.path) for f in listed(self.files.uri) if f.modified_ms <= now), default=(-1, ""))
        return {"modified_ms": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = ((o["modified_ms"], o["path"]) for o in (start, end))
        return dealt([f for f in listed(self.files.uri) if low < (f.modified_ms, f.path) <= high], self.files.most)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.files.rows(partition.files)


class DocumentFolder(api.DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _DDL + ("" if self.options.get("content", "true").lower() == "false" else ", content binary")

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema: object) -> FolderStreamReader:  # noqa: N802
        return FolderStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFolder)


def documents(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The files of a folder.

    Spark keeps what a loaded DataFrame pushed last and asks again only if a filter can be pushed: the condition that
    always holds makes it ask for every query, so that the DataFrame may be used with other filters.
    """
    register(spark)
    return spark.read.format(NAME).options(**options).load(folder).where("size >= 0")


def document_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of the folder's accepted files in all formats that have an adapter; doc_id is the path."""
    files = documents(spark, folder).where("reject IS NULL")
    return blocks_of(files.select(F.col("path").alias("doc_id"), "name", F.lit("").alias("mime"), "content"))


def write_files(df: DataFrame, folder: str) -> int:
    """Writes each row's ``content`` to ``name`` below a folder, in tasks; a row that is written again makes the same file.  Returns the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _system(folder)
        n = 0
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                path = os.path.join(inner, name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(data or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
