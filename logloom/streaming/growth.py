"""A streaming source of log files that grow.

The offset of the stream is the number of a listing: path, size, time, and a checksum of the last bytes of every log file, stored beside the others in
a folder of the caller's.  A micro-batch holds the byte ranges that were added between two listings, in partitions of bounded size.  A line
belongs to the range that holds its newline, so a line that is still being written comes with the batch that completes it, whole.

A file that shrank, or whose old end is not what it was, has been replaced: it is read from the start under the next ``epoch``.  A file that goes is
forgotten; if it comes back it is a new one.  Listings that no batch can ask for any more are deleted.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logloom.session import ship_package
from logloom.sources.discovery import IGNORED
from logloom.sources.ranges import BLOCK, RANGE, folder_store, listable, open_file, spans_in, tail

SCHEMA = "file_path string, epoch bigint, byte_start bigint, byte_end bigint, value string"
LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("epoch", pa.int64()), ("tail", pa.int64())])


@dataclass(frozen=True)
class Entry:
    size: int
    modified: int
    epoch: int
    tail: int


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    if not listable(path):
        raise ValueError(f"a stream cannot list {path}; name a folder that tasks can open")
    return folder_store(path)


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, roots: list[str], state: str):
        self.roots, self.state = roots, state
        self.kept: dict[int, dict[str, Entry]] = {}

    # --- listings

    def _listing(self, number: int) -> dict[str, Entry]:
        if number == 0:
            return {}
        if number not in self.kept:
            store, inner, _ = _store(self.state)
            rows = pq.read_table(f"{inner}/{number}.parquet", filesystem=store, schema=LISTED).to_pylist()
            self.kept = {n: x for n, x in self.kept.items() if n == number - 1}
            self.kept[number] = {r.pop("path"): Entry(**r) for r in rows}
        return self.kept[number]

    def _numbers(self) -> list[int]:
        store, inner, _ = _store(self.state)
        found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return sorted(int(x.base_name.removesuffix(".parquet")) for x in found if re.fullmatch(r"[0-9]+\.parquet", x.base_name))

    def _now(self, old: dict[str, Entry]) -> dict[str, Entry]:
        """What is there now; only files that changed are opened, for a few bytes each."""
        out: dict[str, Entry] = {}
        changed: list[tuple[str, int, int]] = []
        for root in self.roots:
            store, inner, before = _store(root)
            for info in store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
                path = before + info.path
                if info.type != fs.FileType.File or not path.endswith(".jsonl") or re.search(IGNORED, path) or path in out:
                    continue
                was, modified = old.get(path), info.mtime_ns or 0
                if was and (was.size, was.modified) == (info.size, modified):
                    out[path] = was
                elif info.size:
                    changed.append((path, info.size, modified))

        def entry(item: tuple[str, int, int]) -> tuple[str, Entry]:
            path, size, modified = item
            file, was = open_file(path), old.get(path)
            grown = was is not None and size >= was.size and tail(file, was.size)[0] == was.tail
            epoch = was.epoch if grown else was.epoch + 1 if was else 0
            return path, Entry(size, modified, epoch, tail(file, size)[0])

        with ThreadPoolExecutor(16) as pool:
            out |= dict(pool.map(entry, changed))
        return out

    # --- the stream

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        old = self._listing(last)
        now = self._now(old)
        if now == old:
            return {"listing": last}
        store, inner, _ = _store(self.state)
        store.create_dir(inner, recursive=True)
        rows = [{"path": p, "size": e.size, "modified": e.modified, "epoch": e.epoch, "tail": e.tail} for p, e in now.items()]
        pq.write_table(pa.Table.from_pylist(rows, LISTED), f"{inner}/{last + 1}.tmp", filesystem=store)
        store.move(f"{inner}/{last + 1}.tmp", f"{inner}/{last + 1}.parquet")
        self.kept[last + 1] = now
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Byte ranges (path, epoch, start, stop); each partition has up to ``RANGE`` bytes."""
        old, new = self._listing(start["listing"]), self._listing(end["listing"])
        parts, held, size = [], [], 0
        for path, entry in sorted(new.items()):
            was = old.get(path)
            at = was.size if was and was.epoch == entry.epoch else 0
            while at < entry.size:
                stop = min(entry.size, at + RANGE - size)
                held.append((path, entry.epoch, at, stop))
                size, at = size + stop - at, stop
                if size >= RANGE:
                    parts.append(InputPartition(tuple(held)))
                    held, size = [], 0
        if held:
            parts.append(InputPartition(tuple(held)))
        return parts or [InputPartition(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, epoch, start, stop in partition.value:
            lines, size = [], 0
            for line in spans_in(open_file(path), start, stop):
                lines.append(line)
                size += len(line[2])
                if size >= 4 * BLOCK or len(lines) >= 10_000:
                    yield _batch(path, epoch, lines)
                    lines, size = [], 0
            if lines:
                yield _batch(path, epoch, lines)

    def commit(self, end: dict) -> None:
        """Listings before the committed one are not asked for again."""
        store, inner, _ = _store(self.state)
        for number in self._numbers():
            if number < end["listing"]:
                store.delete_file(f"{inner}/{number}.parquet")


def _batch(path: str, epoch: int, lines: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    starts, ends, values = zip(*lines)
    n, long = len(lines), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([epoch] * n, long), pa.array(starts, long), pa.array(ends, long),
                                       pa.array([v.decode("utf-8", "replace") for v in values], pa.string())], names=["file_path", "epoch", "byte_start", "byte_end", "value"])


class GrowingLines(DataSource):
    """``format("growing_lines")`` with the options ``path`` (folders, one per line) and ``listings`` (a folder of its own per stream)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader([p.rstrip("/") for p in self.options["path"].split("\n")], self.options["listings"].rstrip("/"))


def growing_lines(spark: SparkSession, roots: list[str], listings: str) -> DataFrame:
    """A stream of (file_path, epoch, byte_start, byte_end, value): every complete line of the logs below ``roots``, once.

    A line begins at ``byte_start`` and the next one at ``byte_end``, so an order and gaps can be told.  ``listings`` is a folder that belongs to this stream
    alone, like its checkpoint.
    """
    ship_package(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", "\n".join(os.path.abspath(r) if "://" not in r else r for r in roots)).option(
        "listings", listings if "://" in listings else os.path.abspath(listings)).load()
