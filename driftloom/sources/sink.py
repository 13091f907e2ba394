"""A sink of one file per row, committed in two steps.

``df.write.format("files").save(folder)`` writes each row's ``content`` to ``folder/name``. A task writes
beside the folder's files, to names of its own; only when all tasks are done are the files moved to
their names, so a lost executor or a failed job leaves no half-written file under a final name. A
file ``_SUCCESS`` then tells that the folder is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from driftloom.sources import store

#: Files that are moved to their names at a time.
MOVES = 16


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files, and their names."""

    folder: str
    names: list[str]


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"])


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        system, path = store.located(self.path)
        return system, path, f"{path}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, staging = self._staging()
        folder, names, made = f"{staging}/{uuid.uuid4().hex}", [], set()
        for row in iterator:
            to = f"{folder}/{row['name']}"
            if ".." in row["name"].split("/"):
                raise ValueError(f"{row['name']!r} leaves the folder")
            parent = to.rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            with system.open_output_stream(to) as f:
                f.write(row["content"])
            names.append(row["name"])
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path, staging = self._staging()
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"{len(names) - len(set(names))} row(s) have the name of another")
        for folder in {f"{path}/{n}".rpartition("/")[0] for n in names} | {path}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda x: system.move(*x), [(f"{m.folder}/{n}", f"{path}/{n}") for m in done for n in m.names]):
                pass  # raises what a move has raised
        self.abort(messages)
        with system.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, _, staging = self._staging()
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Every row's ``content`` as a file ``name`` (which may have folders) below ``folder``; names must differ."""
    rows.sparkSession.dataSource.register(FilesSink)
    rows.selectExpr(f"cast({name} as string) as name", f"cast({content} as binary) as content").write.format("files").mode("append").save(folder)
