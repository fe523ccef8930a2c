"""Folders searched by Spark tasks.

Each round lists the folders found so far that nobody has listed.  A task goes on below a folder for ``AHEAD`` folders and hands back what it
has not opened, so a small tree ends in one round and a large one is dealt over all tasks by the next.  Links are followed: a folder counts once, by where it
really lies, so loops end.  Folders that cannot be read, or are gone by then, are left out.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import ship_package, stage_table
from logloom.sources.ranges import folder_store

#: Folders that a task lists below one that it was given.
AHEAD = 256
#: Rows of a task's batch.
ROWS = 10_000
# Folders never searched.
IGNORED_NAMES = ["node_modules", ".git"]

#: ``state``: a file, a named file, a folder that was listed, or one that has to be.  ``real`` names the place without links in its folders.
FOUND = "path string, real string, state string, size bigint, modified bigint"
_SCHEMA = pa.schema([("path", pa.string()), ("real", pa.string()), ("state", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])


def _entries(path: str, real: str) -> Iterator[tuple[str, str, bool, bool, int, int]]:
    """(name, real path, is a folder, is a link, size, time in milliseconds) of what a folder holds."""
    if "://" not in path:
        with os.scandir(path) as found:
            for entry in found:
                try:
                    info, folder, link = entry.stat(), entry.is_dir(), entry.is_symlink()
                except OSError:  # a link to nothing
                    continue
                if folder or entry.is_file():
                    yield entry.name, os.path.realpath(entry.path) if folder and link else f"{real.rstrip('/')}/{entry.name}", folder, link, info.st_size, info.st_mtime_ns // 10**6
        return
    store, inner, _ = folder_store(path)
    for info in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        yield info.base_name, f"{path}/{info.base_name}", info.type == fs.FileType.Directory, False, info.size or 0, (info.mtime_ns or 0) // 10**6


def _below(path: str, real: str, suffixes: tuple[str, ...], ahead: int) -> Iterator[tuple]:
    """Rows of the files below a folder; of the folders listed; and of those left to others, links among them."""
    pending = deque([(path, real)])
    while pending:
        path, real = pending.popleft()
        if not ahead:
            yield path, real, "open", 0, 0
            continue
        ahead -= 1
        yield path, real, "listed", 0, 0
        try:
            for name, place, folder, link, size, modified in _entries(path, real):
                own = f"{path.rstrip('/')}/{name}"
                if folder and name not in IGNORED_NAMES:
                    if link:
                        yield own, place, "open", 0, 0
                    else:
                        pending.append((own, place))
                elif not folder and name.endswith(suffixes):
                    yield own, place, "file", size, modified
        except OSError:
            continue


def _root(path: str) -> Iterator[tuple]:
    """The row of a path that was named."""
    try:
        if "://" not in path:
            info = os.stat(path)
            real, folder, size, modified = os.path.realpath(path), os.path.isdir(path), info.st_size, info.st_mtime_ns // 10**6
            if not folder:
                real = f"{os.path.realpath(os.path.dirname(path)).rstrip('/')}/{os.path.basename(path)}"
        else:
            store, inner, _ = folder_store(path)
            info = store.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                return
            real, folder, size, modified = path, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 10**6
    except OSError:
        return
    yield (path, real, "open", 0, 0) if folder else (path, real, "named", size, modified)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)


def walk(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...], ahead: int = AHEAD) -> DataFrame:
    """(file_path, size, modified, named) of the files below the roots whose name ends in a suffix, and of files that are roots themselves (``named``).

    A file that several paths lead to has one row, with the path free of links if there is one, else the first by name.  Files that are links keep their own path.
    """
    ship_package(spark)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(row for path in batch.column("path").to_pylist() for row in _root(path))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(row for path, real in zip(batch.column("path").to_pylist(), batch.column("real").to_pylist())
                                for row in _below(path, real, suffixes, ahead))

    tasks = max(2, spark.sparkContext.defaultParallelism)
    straight = F.struct(F.col("path") != F.col("real"), F.col("path"))
    found = stage_table(spark.createDataFrame([(r,) for r in roots], "path string").mapInArrow(named, FOUND))
    files, seen = found.filter("state = 'named'"), None
    while True:
        todo = found.filter("state = 'open'").groupBy("real").agg(F.min_by("path", straight).alias("path"))
        todo = stage_table(todo if seen is None else todo.join(seen, "real", "left_anti"))
        if todo.isEmpty():
            break
        found = stage_table(todo.repartition(tasks, "real").mapInArrow(listed, FOUND))
        files = files.unionByName(found.filter("state = 'file'"))
        done = found.filter("state = 'listed'").select("real")
        seen = done if seen is None else seen.unionByName(done)
    return files.groupBy("real").agg(F.min_by("path", straight).alias("file_path"), F.max("size").alias("size"), F.timestamp_millis(F.max("modified")).alias("modified"),
                                     F.max(F.col("state") == "named").alias("named")).drop("real")
