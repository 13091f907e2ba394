"""Members of archives as rows: zip files, and numpy arrays in npz files.

Both are Spark data sources that read an archive's directory of members when they are planned, and
then its members in tasks of their own, some 64 MB of them each: an archive of any size is never
unpacked to disk, nor held by one task.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from driftloom.sources import store

#: Rows of an array that are passed on at once.
ROWS = 4096


class MemberReader(DataSourceReader):
    """Options: pattern (of archive names), members (of member names), bytes (of members that a task reads)."""

    pattern = "*.zip"

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[store.Share]:
        members, found = self.options.get("members", "*"), []
        for path, _ in store.files(self.options["path"], self.options.get("pattern", self.pattern)):
            with store.opened(path) as f, zipfile.ZipFile(f) as z:
                found += [(path, m.filename, m.file_size) for m in z.infolist() if not m.is_dir() and fnmatch.fnmatch(m.filename, members)]
        return store.shares(found, int(self.options.get("bytes", store.SHARE)))

    def read(self, partition: store.Share) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        try:
            for path, member in partition.items:
                if path != last:
                    if held:
                        held.close()
                    last, held = path, zipfile.ZipFile(store.opened(path))
                with held.open(member) as f:
                    yield from self.rows(path, member, held.getinfo(member).file_size, f)
        finally:
            if held:
                held.close()

    def rows(self, path: str, member: str, size: int, f: zipfile.ZipExtFile) -> Iterator[pa.RecordBatch]:
        columns = [pa.array([path]), pa.array([member]), pa.array([size], pa.int64()), pa.array([f.read()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "member", "length", "content"])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "path string, member string, length long, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MemberReader(self.options)


class ArrayReader(MemberReader):
    pattern = "*.npz"

    def rows(self, path: str, member: str, size: int, f: zipfile.ZipExtFile) -> Iterator[pa.RecordBatch]:
        version = np.lib.format.read_magic(f)
        head = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, kind = head(f)
        if kind.hasobject:
            raise ValueError(f"{path}: {member} holds Python objects, which are not read")
        n = shape[0] if shape else 1
        width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
        rows = ROWS if not by_column or len(shape) < 2 else max(n, 1)  # one by columns is whole only at its end
        for first in range(0, n, rows):
            count = min(rows, n - first)
            values = np.frombuffer(_exactly(f, count * width * kind.itemsize, path, member), kind)
            values = values.reshape(shape, order="F").reshape(n, width) if by_column and len(shape) > 1 else values.reshape(count, width)
            flat = pa.array(np.ascontiguousarray(values, np.float64).ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * width, pa.int32()), flat)
            names = [pa.array([x] * count) for x in (path, member.removesuffix(".npy"))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.arange(first, first + count)), vectors], ["path", "array", "row", "vector"])


def _exactly(f: zipfile.ZipExtFile, size: int, path: str, member: str) -> bytes:
    found = f.read(size)
    if len(found) < size:
        raise ValueError(f"{path}: {member} ends {size - len(found)} bytes too early")
    return found


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "path string, array string, row long, vector array<double>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrayReader(self.options)


def _loaded(spark: SparkSession, source: type[DataSource], root: str, options: dict) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: v for k, v in options.items() if v is not None}).load(root)


def read_members(spark: SparkSession, root: str, members: str = "*", pattern: str = "*.zip", bytes: int | None = None) -> DataFrame:  # noqa: A002
    """path, member, length and content of the members of all archives below ``root`` whose names fit."""
    return _loaded(spark, ArchiveSource, root, {"members": members, "pattern": pattern, "bytes": bytes})


def read_arrays(spark: SparkSession, root: str, arrays: str = "*", pattern: str = "*.npz", bytes: int | None = None) -> DataFrame:  # noqa: A002
    """path, array (its name), row and vector of the arrays in all npz files below ``root``; a row of one dimension has one value."""
    return _loaded(spark, ArraySource, root, {"members": f"{arrays}.npy", "pattern": pattern, "bytes": bytes})


def lines(members: DataFrame) -> DataFrame:
    """path, member and value (a line, as ``datasets.text_segments`` takes it) of text members; n, the line's number, from 0."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return members.select("path", "member", F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("n", "value"))
