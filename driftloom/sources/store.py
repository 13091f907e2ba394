"""Files by URI for data sources that read parts of them: opened, listed and written in any store that pyarrow knows.

Whole small files are better read with Spark's own ``binaryFile``; these helpers are for what it
cannot do: ranges of a file, members of an archive, one file per row.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: Bytes of files (or of members) that one task reads, about.
SHARE = 64 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there. ``file:/x`` is a local path, as Spark writes it."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def opened(uri: str) -> pa.NativeFile:
    """A file for reading at any place."""
    system, path = located(uri)
    return system.open_input_file(path)


def files(uri: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(uri, bytes) of a file, or of those below a folder whose names fit ``pattern``, by name; hidden files and folders are left out."""
    system, path = located(uri)
    found = system.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    inside = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    shown = lambda f: not any(x[0] in "._" for x in f.path[len(path) :].split("/") if x)
    kept = [f for f in inside if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and shown(f)]
    return sorted((head + f.path, f.size) for f in kept)


@dataclass
class Share(InputPartition):
    """What one task reads: names (of files, or of members of one) in order."""

    items: list

    def __post_init__(self) -> None:
        super().__init__(None)


def shares(items: list[tuple], most: int = SHARE) -> list[Share]:
    """``items`` (their last field is a number of bytes) in runs of about ``most`` bytes."""
    out, held = [], 0
    for item in items:
        if not out or held >= most:
            out.append(Share([]))
            held = 0
        out[-1].items.append(item[:-1])
        held += item[-1]
    return out or [Share([])]
