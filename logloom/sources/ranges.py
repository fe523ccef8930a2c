"""Byte ranges of log files as lines: what a file gained is read without the bytes before it.

A line belongs to the range that holds its newline, so ranges of one file can be read in parallel and a line is never split or read
twice.  Line ends are those of Spark's text source: newline, carriage return, or both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import ship_package, stage_table
from logloom.sources.lines import is_blank, looks_like_claude

#: Bytes of a range; a longer addition is dealt over several tasks.
RANGE = 64 << 20
BLOCK = 1 << 20
#: Bytes before the end of a file that are compared to tell growth from replacement.
TAIL = 256
#: Schemes that tasks open themselves; files of other stores are read whole by Spark.
SCHEMES = {"": "", "file": "", "s3": "s3", "s3a": "s3", "gs": "gs"}


def ranged(path: Column) -> Column:
    """Whether tasks can open the file at a byte offset."""
    scheme = F.regexp_extract(path, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return scheme.isin(*SCHEMES)


def listable(root: str) -> bool:
    """Whether tasks can list and open what lies below a path or URI."""
    return ("" if "://" not in root else root.split("://", 1)[0]) in SCHEMES


def folder_store(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what a listed path has before it) of a folder that tasks can list."""
    scheme = path.split("://", 1)[0] if "://" in path else ""
    if not SCHEMES[scheme]:
        return fs.LocalFileSystem(), path.removeprefix("file://"), ""
    store, inner = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{path.split('://', 1)[1]}")
    return store, inner, f"{scheme}://"


def open_file(path: str):
    """(file, size) of a path or URI."""
    scheme = urlsplit(path).scheme if "://" in path else ""
    if not SCHEMES[scheme]:
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file://"))
    store, inner = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{path.split('://', 1)[1]}")
    return store.open_input_file(inner)


def line_start(file, at: int) -> int:
    """Where the line that holds byte ``at`` begins."""
    while at > 0:
        low = max(0, at - BLOCK)
        found = file.read_at(at - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def _spans(at: int, piece: bytes, end: int) -> Iterator[tuple[int, int, bytes]]:
    """Lines of the bytes that begin at ``at``; carriage returns end lines too, and the last line ends at ``end``."""
    parts = piece.removesuffix(b"\r").split(b"\r")
    for part in parts[:-1]:
        yield at, at + len(part) + 1, part
        at += len(part) + 1
    yield at, end, parts[-1]


def spans_in(file, start: int, stop: int, rest: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(where it begins, where the next one does, text) of the lines whose newline lies in [start, stop); with ``rest`` also of what follows the last
    newline before ``stop``."""
    at = begin = line_start(file, start)
    held: list[bytes] = []

    def line(piece: bytes, end: int) -> Iterator[tuple[int, int, bytes]]:
        return _spans(begin, piece if begin else piece.removeprefix(b"\xef\xbb\xbf"), end)

    while at < stop:
        block = file.read_at(min(BLOCK, stop - at), at)
        if not block:
            break
        at += len(block)
        *whole, last = block.split(b"\n")
        for i, piece in enumerate(whole):
            if i == 0 and held:
                piece, held = b"".join([*held, piece]), []
            end = begin + len(piece) + 1
            yield from line(piece, end)
            begin = end
        if last:
            held.append(last)
    piece = b"".join(held)
    if rest and (piece if begin else piece.removeprefix(b"\xef\xbb\xbf")):
        yield from line(piece, begin + len(piece))


def lines_in(file, start: int, stop: int, rest: bool = False) -> Iterator[bytes]:
    """The texts of :func:`spans_in`."""
    return (value for _, _, value in spans_in(file, start, stop, rest))


def tail(file, size: int) -> tuple[int, bool]:
    """Checksum of the last bytes before ``size``, and whether they end a line."""
    last = file.read_at(min(TAIL, size), max(0, size - TAIL))
    return zlib.crc32(last), last.endswith(b"\n")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, was, size in zip(*(c.to_pylist() for c in batch.columns)):
            file = open_file(path)
            out.append((path, tail(file, was)[0] if was and was < size else None, *(tail(file, size) if size else (0, True))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))],
                                             names=["file_path", "before", "tail", "terminated"])


def file_ends(files: DataFrame) -> DataFrame:
    """(file_path, before, tail, terminated) of files with (file_path, old_size, size): a few bytes of each are read."""
    ship_package(files.sparkSession)
    return files.select("file_path", "old_size", "size").mapInArrow(_ends, "file_path string, before bigint, tail bigint, terminated boolean")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(path: str, chunk: int, first: int, values: list[bytes]) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([chunk] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(values, pa.binary())],
                                          names=["file_path", "chunk", "pos", "value"])

    for batch in batches:
        for path, start, stop, rest in zip(*(c.to_pylist() for c in batch.columns)):
            values, size, first = [], 0, 0
            for value in lines_in(open_file(path), start, stop, rest):
                values.append(value)
                size += len(value)
                if size >= 4 * BLOCK or len(values) >= 10_000:
                    yield batch_of(path, start, first, values)
                    values, size, first = [], 0, first + len(values)
            if values:
                yield batch_of(path, start, first, values)


def read_added(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of what files gained, and one row per file.

    ``files`` has (file_path, start, size, first_line, provider): bytes from ``start``, which begins a line, up to ``size``; the lines before; and the
    provider where it is known.  Lines are (file_path, chunk, line, value, provider); files are (file_path, line_count, provider, seen), where
    ``seen`` tells that a record has been found by now.  A file that gained no bytes has a row too.
    """
    ship_package(files.sparkSession)
    pieces = files.filter("size > start").select("file_path", "size", F.explode(F.sequence(F.col("start"), F.col("size") - 1, F.lit(RANGE).cast("bigint"))).alias("at"))
    pieces = pieces.select("file_path", F.col("at").alias("start"), F.least(F.col("at") + RANGE, F.col("size")).alias("stop"), (F.col("at") + RANGE >= F.col("size")).alias("rest"))
    # Ranges are dealt by a hash, so the ranges of one file are read by several tasks.
    dealt = pieces.repartition("file_path", "start")
    raw = stage_table(dealt.mapInArrow(_read, "file_path string, chunk bigint, pos bigint, value binary").withColumn("value", F.col("value").cast("string")))
    sums = raw.groupBy("file_path", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", F.when(~is_blank(F.col("value")), F.col("pos"))).alias("first_value"))
    before = W.partitionBy("file_path").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("file_path", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    totals = sums.groupBy("file_path").agg(F.sum("n").alias("added"), F.min_by("first_value", F.when(F.col("first_value").isNotNull(), F.col("chunk"))).alias("first_value"))
    found = stage_table(files.join(totals, "file_path", "left").select(
        "file_path", "first_line", (F.col("first_line") + F.coalesce("added", F.lit(0))).alias("line_count"),
        F.coalesce("provider", F.when(looks_like_claude(F.col("file_path"), F.col("first_value")), "claude").otherwise("codex")).alias("provider"),
        (F.col("provider").isNotNull() | F.col("first_value").isNotNull()).alias("seen")))
    lines = raw.join(offsets, ["file_path", "chunk"]).join(found.select("file_path", "first_line", "provider"), "file_path").select(
        "file_path", "chunk", (F.col("first_line") + F.col("offset") + F.col("pos") + 1).alias("line"), "value", "provider")
    return lines, found.drop("first_line")
