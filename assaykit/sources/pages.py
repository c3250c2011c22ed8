"""Pages of document files as a Spark data source: ``spark.read.format("pages").load(folder)`` after ``register``.

Options: ``pattern`` (names of files, default ``*``), ``reader`` (``package.module:function`` that turns a file's bytes into page texts; default:
UTF-8 texts whose pages end with a form feed, of which a task holds a few pages only), ``groupBytes`` (bytes of files in a partition). Columns: path, page_num (from 1), bytes (of
the file) and text; a schema of fewer of them is filled with those only, and files aren't opened for path and bytes alone.
Filters on path keep other files from being opened. Folders may be on any file system that pyarrow knows.
"""

from __future__ import annotations

import codecs
import fnmatch
import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "path string, page_num int, bytes long, text string"
_KINDS = {"path": pa.string(), "page_num": pa.int32(), "bytes": pa.int64(), "text": pa.string()}
#: Texts of about so many characters go on together.
_BATCH = 8 << 20


def form_feeds(content: bytes) -> list[str]:
    """Pages of a UTF-8 text, which end with form feeds; what is blank behind the last one is no page."""
    pages = content.decode("utf-8", "replace").split("\x0c")
    return pages if pages[-1].strip() else pages[:-1]


def _streamed(file: BinaryIO, block: int = 1 << 20) -> Iterator[str]:
    """Pages of ``form_feeds``, a block of the file at a time."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    parts: list[str] = []
    while content := file.read(block):
        first, *others = decode(content).split("\x0c")
        parts.append(first)
        for page in others:
            yield "".join(parts)
            parts = [page]
    last = "".join([*parts, decode(b"", True)])
    if last.strip():
        yield last


@dataclass
class FileGroup(InputPartition):
    files: list[tuple[str, int]]


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.reader = options.get("reader", f"{form_feeds.__module__}:{form_feeds.__name__}")
        self.group = int(options.get("groupbytes", options.get("groupBytes", 32 << 20)))
        self.names = schema.fieldNames()
        self.tests: list[tuple[str, tuple]] = []
        if unknown := set(self.names) - set(_KINDS):
            raise ValueError(f"pages have no columns {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.tests.append(("starts" if isinstance(f, StringStartsWith) else "in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return all(path.startswith(values) if kind == "starts" else path in values for kind, values in self.tests)

    def partitions(self) -> list[FileGroup]:
        system, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        found = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        files = sorted((x.path, x.size) for x in found if fnmatch.fnmatch(x.base_name, self.pattern) and self._wanted(x.path))
        groups: list[FileGroup] = []
        size = 0
        for path, n in files:
            if not groups or size + n > self.group:
                groups.append(FileGroup([]))
                size = 0
            groups[-1].files.append((path, n))
            size += n
        return groups or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        module, _, name = self.reader.partition(":")
        pages_of = getattr(importlib.import_module(module), name)
        opened = bool({"page_num", "text"} & set(self.names))
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = dict(zip(_KINDS, zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[n], _KINDS[n]) for n in self.names], self.names)

        for path, size in partition.files:
            if not opened:
                rows.append((path, None, size, None))
                continue
            with system.open_input_stream(path) as f:
                for number, text in enumerate(_streamed(f) if pages_of is form_feeds else pages_of(f.read()), 1):
                    rows.append((path, number, size, text))
                    held += len(text)
                    if held > _BATCH:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class PageSource(DataSource):
    """A file is opened by one task; tasks have files of about ``groupBytes`` together. Empty files have no pages, an empty folder no rows."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
