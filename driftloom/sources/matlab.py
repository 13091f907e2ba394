"""MATLAB 5 files: a Spark data source with typed rows, and annotations that are kept in such files.

``spark.read.format("mat").schema(...).load(folder)`` gives a row per file whose columns are the
file's variables, or with ``option("variable", name)`` a row per element of that struct, whose columns
are its fields. A column ``path`` is the file's name. What a file lacks is null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from driftloom.sources import store

#: Fixed values of the format: types of data elements, and classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR, SPARSE, DOUBLE = 1, 2, 4, 5, 6
COMPLEX = 0x0800
HEADER = 128


def elements(data: bytes, order: str = "<") -> Iterator[tuple[int, bytes]]:
    """(type, bytes) of the data elements that follow each other in ``data``; compressed ones are unpacked."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: type, size and data in eight bytes
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        begin = at + 8
        if begin + size > len(data):
            raise ValueError(f"an element of {size} bytes runs past the end")
        if kind == COMPRESSED:
            yield from elements(zlib.decompress(data[begin : begin + size]), order)
            at = begin + size
        else:
            yield kind, data[begin : begin + size]
            at = begin + size + -size % 8


def _numbers(kind: int, data: bytes, order: str) -> np.ndarray:
    if kind not in NUMBERS:
        raise ValueError(f"data of type {kind} where numbers are expected")
    return np.frombuffer(data, np.dtype(NUMBERS[kind]).newbyteorder(order))


def _matrix(data: bytes, order: str) -> tuple[str, object]:
    """(name, value) of an array: numbers as an array of its shape, text as a string (or one per row), structs and cells as lists."""
    if not data:
        return "", np.zeros((0, 0))
    parts = elements(data, order)
    flags = int(_numbers(*next(parts), order)[0])
    shape = tuple(int(n) for n in _numbers(*next(parts), order))
    name = next(parts)[1].decode()
    count, kind = int(np.prod(shape)), flags & 0xFF
    if kind == CELL:
        return name, [_matrix(x, order)[1] for _, x in parts]
    if kind == STRUCT:
        width = int(_numbers(*next(parts), order)[0])
        raw = next(parts)[1]
        fields = [raw[i : i + width].split(b"\0")[0].decode() for i in range(0, len(raw), width)]
        return name, [{f: _matrix(next(parts)[1], order)[1] for f in fields} for _ in range(count)]
    if kind == CHAR:
        what, raw = next(parts, (16, b""))
        order_name = {"<": "-le", ">": "-be"}[order]
        text = raw.decode(TEXTS[what] + (order_name if what > 16 else "")) if what in TEXTS else "".join(map(chr, _numbers(what, raw, order)))
        rows = shape[0] if len(shape) > 1 else 1
        return name, text if rows <= 1 else [text[i::rows] for i in range(rows)]
    if kind == SPARSE or not DOUBLE <= kind <= 15:
        raise ValueError(f"{name or 'an array'} is of class {kind}, which can't be read")
    values = _numbers(*next(parts, (9, b"")), order)
    if flags & COMPLEX:
        values = values + 1j * _numbers(*next(parts), order)
    return name, values.reshape(shape, order="F")


def variables(content: bytes) -> dict[str, object]:
    """The variables of a file's bytes by name."""
    if len(content) < HEADER or content[126:128] not in (b"IM", b"MI"):
        raise ValueError("no MATLAB 5 file")
    order = "<" if content[126:128] == b"IM" else ">"
    return dict(_matrix(data, order) for kind, data in elements(content[HEADER:], order) if kind == MATRIX)


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _array(name: str, value: object) -> bytes:
    if isinstance(value, str):
        kind, shape, body = CHAR, (min(1, len(value)), len(value)), _element(17, value.encode("utf-16-le"))
    elif isinstance(value, dict):
        return _array(name, [value])
    elif isinstance(value, list) and all(isinstance(x, dict) for x in value):
        fields = list(value[0]) if value else []
        width = max([len(f) for f in fields], default=0) + 1
        body = _element(5, struct.pack("<i", width)) + _element(1, b"".join(f.encode().ljust(width, b"\0") for f in fields))
        kind, shape, body = STRUCT, (1, len(value)), body + b"".join(_array("", x[f]) for x in value for f in fields)
    elif isinstance(value, list) and any(isinstance(x, (str, list, dict)) for x in value):
        kind, shape, body = CELL, (1, len(value)), b"".join(_array("", x) for x in value)
    else:
        numbers = np.atleast_2d(np.asarray(value, np.float64))
        kind, shape, body = DOUBLE, numbers.shape, _element(9, numbers.tobytes(order="F"))
    head = _element(6, struct.pack("<II", kind, 0)) + _element(5, struct.pack(f"<{len(shape)}i", *shape)) + _element(1, name.encode())
    return _element(MATRIX, head + body)


def encoded(values: dict[str, object], packed: bool = True) -> bytes:
    """The bytes of a file with these variables: numbers, texts, lists of either, and dictionaries as structs."""
    out = [b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"]
    for name, value in values.items():
        data = _array(name, value)
        if packed:
            data = zlib.compress(data)
            data = struct.pack("<II", COMPRESSED, len(data)) + data
        out.append(data)
    return b"".join(out)


def _flat(value: object) -> list:
    return value.ravel(order="F").tolist() if isinstance(value, np.ndarray) else value if isinstance(value, list) else [value]


def typed(value: object, kind: T.DataType) -> object:
    """``value`` as Spark's ``kind``: arrays are read column by column, single values and one-element structs stand for themselves."""
    if isinstance(kind, T.ArrayType):
        return None if value is None else [typed(x, kind.elementType) for x in _flat(value)]
    if isinstance(kind, T.StructType):
        found = _flat(value)[0] if value is not None and _flat(value) else None
        return None if found is None else tuple(typed(found.get(f.name), f.dataType) for f in kind.fields)
    found = [value] if isinstance(value, str) else [] if value is None else _flat(value)
    if isinstance(kind, T.StringType):
        return "" if value is not None and not found else str(found[0]) if found else None
    if not found:
        return None
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        return int(found[0])
    if isinstance(kind, T.BooleanType):
        return bool(found[0])
    return float(found[0])


def rows_of(content: bytes, variable: str | None) -> list[dict]:
    """What a file has a row for: all its variables, or the elements of the struct ``variable``."""
    found = variables(content)
    if variable is None:
        return [found]
    return [x for x in _flat(found.get(variable, [])) if isinstance(x, dict)]


class MatSource(DataSource):
    """Options: variable (the struct to read), pattern (of file names, ``*.mat``), bytes (of files that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MatReader(schema, self.options)


class MatReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.kinds, self.options = schema, dict(options)

    def partitions(self) -> list[store.Share]:
        found = store.files(self.options["path"], self.options.get("pattern", "*.mat"))
        return store.shares(found, int(self.options.get("bytes", store.SHARE)))

    def read(self, partition: store.Share) -> Iterator[tuple]:
        for (path,) in partition.items:
            with store.opened(path) as f:
                content = f.read()
            try:
                found = rows_of(content, self.options.get("variable"))
                for row in found:
                    yield tuple(path if f.name == "path" else typed(row.get(f.name), f.dataType) for f in self.kinds.fields)
            except (ValueError, struct.error, zlib.error, StopIteration) as e:
                raise ValueError(f"{path}: {e}") from e


def read_mat(spark: SparkSession, root: str, schema: str, variable: str | None = None, pattern: str = "*.mat", **options: int) -> DataFrame:
    """A row per file below ``root``, or per element of its struct ``variable``, with the columns of ``schema``."""
    spark.dataSource.register(MatSource)
    source = spark.read.format("mat").schema(schema).options(pattern=pattern, **options)
    return (source.option("variable", variable) if variable else source).load(root)


#: The fields of a bird's measurements, kept in the struct ``D``.
MEASUREMENTS = "path string, birdname string, `group` string, timestamps array<double>, quantity array<double>, annotations array<struct<text:string,timestamp:double>>"


def measurements(spark: SparkSession, root: str) -> DataFrame:
    """A row per file: birdname, group, timestamps (days), quantity and annotations; see :func:`datasets.marked`."""
    return read_mat(spark, root, MEASUREMENTS, "D")


def notmat(content: bytes) -> list[tuple[float, float, str]]:
    """The intervals of a file with onsets and offsets in milliseconds and a label of one character each."""
    found = variables(content)
    lacking = [c for c in ("onsets", "offsets", "labels") if c not in found]
    if lacking:
        raise ValueError(f"lacks the variable(s) {lacking}")
    onsets, offsets = (np.ravel(found[c]).astype(float) / 1000 for c in ("onsets", "offsets"))
    labels = "".join(_flat(found["labels"])) if len(onsets) else ""
    if not len(onsets) == len(offsets) == len(labels):
        raise ValueError(f"{len(onsets)} onsets, {len(offsets)} offsets and {len(labels)} labels")
    return list(zip(onsets.tolist(), offsets.tolist(), labels))


def yarden(files: DataFrame) -> DataFrame:
    """audio_file, onset_s, offset_s and label of files (path, value) that annotate many recordings: ``keys`` and ``elements``."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["value"]):
                found = variables(content)
                out = []
                for key, one in zip(_flat(found["keys"]), _flat(found["elements"])):
                    one = _flat(one)[0]
                    columns = [_flat(one[c]) for c in ("segFileStartTimes", "segFileEndTimes", "segType")]
                    if len({len(c) for c in columns}) > 1:
                        raise ValueError(f"{path}: the segments of {key} have columns of different lengths")
                    out += [(key, float(a), float(b), f"{c:g}" if not isinstance(c, str) else c) for a, b, c in zip(*columns)]
                yield pd.DataFrame(out, columns=["audio_file", "onset_s", "offset_s", "label"])

    return files.select("path", "value").mapInPandas(parse, "audio_file string, onset_s double, offset_s double, label string")
