"""A partitioned listing of a folder tree as a Spark data source.

Spark's file source leaves out empty files and names that begin with ``_`` or ``.``; a listing for search needs them
all. The driver opens the first levels of the tree only, until there are enough folders to deal out; a partition
is a folder, listed with everything below it where the rows are wanted. Links are not followed, and folders that
may not be read are passed over.

``spark.read.format("folder_listing").load(root)``; option ``depth`` bounds how deep folders are opened, ``partitions``
how many folders are looked for.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# tasks need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "folder_listing"
LAYOUT = "path string, length bigint, mtime double"
#: Rows of a batch, folders looked for if none is asked for.
ROWS, PARTITIONS = 10_000, 64


@dataclass(frozen=True)
class Entry:
    path: str
    is_folder: bool
    length: int
    mtime: float


def entries(folder: str) -> Iterator[Entry]:
    """What lies directly in a folder; nothing where it may not be read or is gone."""
    if "://" not in folder or folder.startswith("file:"):
        try:
            with os.scandir(local_path(folder)) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        yield Entry(e.path, True, 0, 0.0)
                    elif e.is_file(follow_symlinks=False):
                        stat = e.stat(follow_symlinks=False)
                        yield Entry(e.path, False, stat.st_size, stat.st_mtime)
        except (PermissionError, FileNotFoundError):
            return
    else:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        scheme = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.type in (fs.FileType.Directory, fs.FileType.File):
                yield Entry(scheme + info.path, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) / 1e9)


def local_path(path: str) -> str:
    """``file:///a`` and ``/a`` are the same file."""
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


class Folder(InputPartition):
    """A folder; ``below`` tells how many more levels belong to it (None: all, -1: only its own files)."""

    def __init__(self, path: str, below: int | None):
        super().__init__(path)
        self.path, self.below = path, below


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("load() takes the root folder")
        self.root = options["path"]
        self.depth = int(options["depth"]) if "depth" in options else None
        self.wanted = int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[InputPartition]:
        """Levels are opened one by one while they have fewer folders than are looked for."""
        level, whole, opened = [self.root], [], 0
        while level and len(level) + len(whole) < self.wanted and (self.depth is None or opened < self.depth):
            below = [e.path for folder in level for e in entries(folder) if e.is_folder]
            whole += [Folder(folder, -1) for folder in level]
            level, opened = below, opened + 1
        left = None if self.depth is None else self.depth - opened
        return whole + [Folder(folder, left) for folder in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        names, held = ["path", "length", "mtime"], []

        def out() -> pa.RecordBatch:
            columns = [[e.path for e in held], [e.length for e in held], [e.mtime for e in held]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()), strict=True)], names)

        waiting = [(partition.path, partition.below)]
        while waiting:
            folder, below = waiting.pop()
            for e in entries(folder):
                if not e.is_folder:
                    held.append(e)
                elif below is None or below > 0:
                    waiting.append((e.path, None if below is None else below - 1))
                if len(held) >= ROWS:
                    yield out()
                    held.clear()
        yield out()


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LAYOUT

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def listing(spark: SparkSession, root: str, depth: int | None = None, partitions: int | None = None) -> DataFrame:
    """(path, length, mtime) of every file below ``root``."""
    spark.dataSource.register(FolderListing)
    reader = spark.read.format(NAME)
    for option, value in (("depth", depth), ("partitions", partitions)):
        reader = reader.option(option, value) if value is not None else reader
    return reader.load(root)


#: Bytes of files that a task holds at a time.
HELD = 32_000_000


def with_bytes(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the column ``bytes``; a file that can't be read any more has none."""
    names = [*files.columns, "bytes"]
    at = files.columns.index(path)

    def content(name: str) -> bytes | None:
        try:
            if "://" not in name or name.startswith("file:"):
                with open(local_path(name), "rb") as file:
                    return file.read()
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(name)
            with system.open_input_stream(base) as stream:
                return stream.read()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, held = 0, 0, []
            for row, name in enumerate(batch.column(at).to_pylist()):
                held.append(content(name))
                size += len(held[-1] or b"")
                if size >= HELD or row + 1 == batch.num_rows:
                    part = batch.slice(start, row + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=names)
                    start, size, held = row + 1, 0, []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{schema}, bytes binary")
