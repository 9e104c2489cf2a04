"""Formats of the user's own as Python data sources: files of lines, read in splits, with pushed filters, and as streams.

A format names its fields and turns lines into records; everything else is here.  Files are cut into splits by
bytes, and a line belongs to the split it starts in.  Filters that Spark pushes, if the load allows it, are asked before a
record leaves the worker.  As a stream, a source gives what has been added to its
folder: new files, and whole lines at the end of files that grow.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a split, of one read, and records of a batch handed to Spark.
SPLIT, READ, BATCH = 64 << 20, 1 << 20, 8192


@dataclass
class Split(ds.InputPartition):
    """Lines of a file that start at byte low or later, and before high."""

    path: str
    low: int
    high: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> dict[str, int]:
    """Data files at path (a file or a folder with folders) and their bytes; names that start with . or _ are none."""
    store, at = _opened(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(at) :].strip("/").split("/") if part)
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not hidden(f.path)}


def lines_of(path: str, split: Split) -> Iterator[bytes]:
    """The split's lines without their ends; a file is read in pieces, so only a line is ever held whole."""
    store, _ = _opened(path)
    with store.open_input_file(split.path) as file:
        # A line starts after a line end, so one byte before the split tells whether its first bytes belong to a line before.
        at = max(split.low - 1, 0)
        file.seek(at)
        rest, skip = b"", split.low > 0
        while at < split.high:
            piece = file.read(READ)
            *whole, rest = (rest + piece).split(b"\n")
            for line in whole:
                start, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif start < split.high:
                    yield line
                else:
                    return
            if not piece:
                if rest and not skip and at < split.high:
                    yield rest
                return


def last_line_end(path: str, name: str, low: int, high: int) -> int:
    """Where the last whole line of a file ends, looking back from high, or low if there is none after it."""
    store, _ = _opened(path)
    with store.open_input_file(name) as file:
        while high > low:
            at = max(low, high - READ)
            file.seek(at)
            found = file.read(high - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            high = at
    return low


_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda f: lambda v: v is not None and v == f.value,
    ds.EqualNullSafe: lambda f: lambda v: v == f.value,
    ds.In: lambda f: lambda v: v is not None and v in f.value,
    ds.GreaterThan: lambda f: lambda v: v is not None and v > f.value,
    ds.GreaterThanOrEqual: lambda f: lambda v: v is not None and v >= f.value,
    ds.LessThan: lambda f: lambda v: v is not None and v < f.value,
    ds.LessThanOrEqual: lambda f: lambda v: v is not None and v <= f.value,
    ds.StringStartsWith: lambda f: lambda v: v is not None and v.startswith(f.value),
    ds.IsNull: lambda f: lambda v: v is None,
    ds.IsNotNull: lambda f: lambda v: v is not None,
}


class LineReader(ds.DataSourceReader):
    """Splits of all files, each read by a task."""

    def __init__(self, source: LineFormat, schema: T.StructType):
        self.source, self.schema, self.tests = source, schema, []
        self.path, self.split = source.options["path"], int(source.options.get("split", SPLIT))
        self.pushes = source.options.get("push", "false").lower() == "true"

    def pushFilters(self, filters):
        """Take what can be asked of a record, where the load allows it."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if self.pushes and type(f) in _TESTS and len(name) == 1 and name[0] in self.schema.names:
                self.tests.append((self.schema.names.index(name[0]), f))
            else:
                yield f

    def partitions(self):
        cut = lambda p, size: [Split(p, low, min(low + self.split, size)) for low in range(0, size, self.split)]
        return [s for p, size in sorted(files_of(self.path).items()) for s in cut(p, size)] or [Split("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from self.batches(partition)

    def batches(self, split: Split) -> Iterator[pa.RecordBatch]:
        tests = [(i, _TESTS[type(f)](f)) for i, f in self.tests]
        kinds = to_arrow_schema(self.schema)
        made: list[tuple] = []
        for line in lines_of(self.path, split):
            record = self.source.record(line)
            if record is not None and all(test(record[i]) for i, test in tests):
                made.append(record)
            if len(made) == BATCH:
                yield _batch(made, kinds)
                made = []
        if made:
            yield _batch(made, kinds)


def _batch(records: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records, strict=True), kinds, strict=True)], schema=kinds)


class LineStream(ds.DataSourceStreamReader):
    """An offset is how many bytes of each file have been given; a batch is what lies between two of them.

    Offsets hold a number for each file of the folder, so folders that files stay in for good should be read by hours or days.
    """

    def __init__(self, source: LineFormat, schema: T.StructType):
        self.inner = LineReader(source, schema)
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for name, size in files_of(self.inner.path).items():
            low = self.last.get(name, 0)
            if size > low:
                self.last[name] = last_line_end(self.inner.path, name, low, size)
        return {"files": json.dumps({name: end for name, end in sorted(self.last.items()) if end})}

    def partitions(self, start: dict, end: dict):
        before, after = json.loads(start["files"]), json.loads(end["files"])
        step = self.inner.split
        cut = lambda p, low, high: [Split(p, a, min(a + step, high)) for a in range(low, high, step)]
        return [s for p, high in after.items() if high > before.get(p, 0) for s in cut(p, before.get(p, 0), high)] or [Split("", 0, 0)]

    def read(self, partition):
        return self.inner.read(partition)

    def commit(self, end: dict) -> None:
        pass


class LineFormat(ds.DataSource):
    """A format with a record a line.  A subclass gives name(), schema() and record(); options: path, split (bytes), push (false).

    push lets filters go down to the reader.  Spark keeps one reader for a load, with the filters it planned last, so a load
    that pushes is for one scan: a table that is joined with itself, or used by several branches, is loaded for each.
    """

    def record(self, line: bytes) -> tuple | None:
        """Values of a line in the order of the schema, or None for a line that is no record."""
        raise NotImplementedError

    def reader(self, schema: T.StructType) -> LineReader:
        return LineReader(self, schema)

    def streamReader(self, schema: T.StructType) -> LineStream:
        return LineStream(self, schema)


_ESCAPES = {"\\\\": "\\", "\\t": "\t", "\\n": "\n"}


class Cells(LineFormat):
    """Cells of sheets, a line each: sheet, row, column and value with tabs between; \\t, \\n and \\\\ stand for these signs, \\N for no value."""

    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> T.StructType:
        kinds = {"sheet": T.StringType(), "row_no": T.IntegerType(), "col": T.IntegerType(), "value": T.StringType()}
        return T.StructType([T.StructField(n, k) for n, k in kinds.items()])

    def record(self, line: bytes) -> tuple | None:
        parts = line.decode("utf-8", "replace").rstrip("\r").split("\t")
        if len(parts) != 4 or not (parts[1].isdecimal() and parts[2].isdecimal()):
            return None
        value = None if parts[3] == "\\N" else parts[3]
        if value and "\\" in value:
            value = _unescaped(value)
        return parts[0], int(parts[1]), int(parts[2]), value


def _unescaped(value: str) -> str:
    out, at = [], 0
    while at < len(value):
        two = value[at : at + 2]
        out.append(_ESCAPES.get(two, value[at]))
        at += 2 if two in _ESCAPES else 1
    return "".join(out)


def register(spark: SparkSession, *formats: type[LineFormat]) -> None:
    """Make formats known to a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in formats or (Cells,):
        spark.dataSource.register(kind)
