"""A data source that lists folders: ``spark.read.format("derlem_walk").option("roots", '["/data"]').load()`` gives path, mtime (ms), size.

Planning opens folders, nearest first, until there are enough for the tasks; each task then walks what lies below its own. Skipped folders are
never opened, and neither are links, which may lead in circles. A folder or file that can't be read is left out, like one that has gone.
Contents aren't touched: ``contents`` fetches those of given paths. Paths are of a file system that is mounted on the driver and all executors."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, mtime long, size long"
#: Folders for which planning stops opening more; bytes of files that leave a task's Python together; rows of a listing that do.
FOLDERS, FETCH_BYTES, ROWS = 1000, 32 << 20, 10_000


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with what lies below; else its own files only


def entries(folder: str) -> Iterator[os.DirEntry]:
    """What is in a folder, without links, and without names that aren't text."""
    try:
        with os.scandir(folder) as found:
            for entry in found:
                if _is_text(entry.name) and not entry.is_symlink():
                    yield entry
    except OSError:
        return


def _is_text(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def enters(name: str, skipped: frozenset[str]) -> bool:
    return not (name.startswith(".") or name.lower() in skipped or name.lower().endswith(".app"))


class WalkReader(DataSourceReader):
    def __init__(self, roots: list[str], skipped: frozenset[str], folders: int):
        self.roots, self.skipped, self.folders = roots, skipped, folders

    def _below(self, folder: str) -> list[str]:
        return [e.path for e in entries(folder) if e.is_dir(follow_symlinks=False) and enters(e.name, self.skipped)]

    def partitions(self) -> list[InputPartition]:
        open_, shut = [], deque(self.roots)
        while shut and len(open_) + len(shut) < self.folders:
            folder = shut.popleft()
            open_.append(folder)
            shut.extend(self._below(folder))
        return [Folder(f, False) for f in open_] + [Folder(f, True) for f in shut] or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        todo, rows = [partition.path] if partition.path else [], []
        while todo:
            for entry in entries(todo.pop()):
                try:
                    if entry.is_dir(follow_symlinks=False):
                        if partition.deep and enters(entry.name, self.skipped):
                            todo.append(entry.path)
                    elif entry.is_file(follow_symlinks=False):
                        stat = entry.stat(follow_symlinks=False)
                        rows.append((entry.path, stat.st_mtime_ns // 1_000_000, stat.st_size))
                except OSError:  # gone or shut since it was listed
                    continue
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    path, mtime, size = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(mtime, pa.int64()), pa.array(size, pa.int64())], names=["path", "mtime", "size"])


class Walk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "derlem_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        roots = [r.rstrip("/") or "/" for r in json.loads(self.options["roots"])]
        return WalkReader(roots, frozenset(json.loads(self.options.get("skipped", "[]"))), int(self.options.get("folders", FOLDERS)))


def contents(files: DataFrame) -> DataFrame:
    """files(path, mtime, size) with content, null where a file can't be read. Nothing but these files is opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, size = [], 0, 0
            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with open(path, "rb") as f:
                        data.append(f.read())
                    size += len(data[-1])
                except OSError:
                    data.append(None)
                if size >= FETCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(data))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=["path", "mtime", "size", "content"])
                    data, start, size = [], i + 1, 0

    # A number of partitions of its own: rows of paths are small, and would all be put into one task that then reads every file.
    spread = files.select("path", "mtime", "size").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(run, SCHEMA + ", content binary")
