"""Best-fit packing by sums of squares.

A document's tokens are cut into pieces of at most ``size`` tokens; pieces are placed into sequences of that size.  Full pieces are
sequences of their own.  The others are packed group by group: each piece goes where the sum, over all residual gaps, of the squared
count of open sequences with that gap becomes smallest, a new sequence being one of the choices.  What lies in sequences that
stay open is placed anew as long as that saves any.  Pieces come largest first, ties by document and piece, so a task that runs again
places them alike.  A group holds about ``group`` pieces, whatever the size of the input.

Defined results: a null text is empty, so its document is the end token alone; repeated rows are packed as often as they come; a null
document id is a document; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import bpe
from logloom.llm.common import Staged, own_columns, ship, slices, whole_groups


_ENCODERS: dict = {}

#: Characters of white space in a row from which a run is encoded as a piece of its own: the compiled library's pattern fails on a million.
RUN = 100_000


def _encode(fast: tiktoken.Encoding, text: str) -> bytes:
    return fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def _encode_runs(fast: tiktoken.Encoding, pairs: bpe.BytePairs, text: str, run: int) -> bytes:
    """The same ids, long runs of white space aside: the pattern makes one piece of a run, without its last character where a text goes on."""
    out, longest = [], regex.compile(rf"\s{{{run},}}")
    for part in pairs.at_added.split(text) if pairs.at_added else [text]:
        if part in pairs.added:
            out.append(_encode(fast, part))
            continue
        done = 0
        for found in longest.finditer(part):
            start, stop = found.start(), found.end() - (found.end() < len(part))
            ids = fast._core_bpe.encode_single_piece(part[start:stop].encode()) if start < stop else []
            out += [_encode(fast, part[done:start]), np.array(ids, "<u4").tobytes()]
            done = stop
        out.append(_encode(fast, part[done:]))
    return b"".join(out)


def _encoder(vocabulary: str):
    """Text to packed ids, once per process.  Where a vocabulary's ids follow its merges, a compiled library gives the same ids sooner."""
    if vocabulary not in _ENCODERS:
        pairs = bpe.load(vocabulary)
        if pairs.ranked:
            fast = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=pairs.ids, special_tokens=pairs.added)
            _ENCODERS[vocabulary] = lambda text: _encode(fast, text) if len(text) < RUN else _encode_runs(fast, pairs, text, RUN)
        else:
            _ENCODERS[vocabulary] = pairs.encode
    return _ENCODERS[vocabulary]


def cut(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text: doc_id, piece, start, length, ids_crc32 (and ids, packed, if asked for).

    Only documents longer than ``size`` are cut; all their pieces are full but the first, which takes the rest.
    """
    ship(docs.sparkSession)
    rows = own_columns(docs, doc_id="doc_id", text="text")
    end = int(end_id).to_bytes(4, "little")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[] for _ in range(6)]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = (encode(text) if text else b"") + end
                    n, start, piece = len(ids) // 4, 0, 0
                    length = n % size or size
                    while start < n:
                        own = ids[4 * start: 4 * (start + length)]
                        for column, value in zip(out, (doc, piece, start, length, zlib.crc32(own), own if with_ids else b"")):
                            column.append(value)
                        start, piece, length = start + length, piece + 1, size
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                types = [part.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types[: len(names)])], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class SumOfSquares:
    """Open sequences of one group, by residual gap."""

    def __init__(self, size: int):
        self.size, self.made = size, 0
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece of ``length``."""
        size, count = self.size, self.count
        # a sequence going from gap g to g - length changes the sum by 2 * (count[g - length] - count[g] + 1); a full one is no longer counted
        change = 2 * (count[: size - length + 1] - count[length:] + 1)
        change[0] = 1 - 2 * count[length]
        change[count[length:] == 0] = np.iinfo(np.int64).max
        gap = int(change.argmin()) + length
        fresh = 2 * int(count[size - length]) + 1 if length < size else 0
        if self.count[gap] and change[gap - length] <= fresh:
            sequence = self.open[gap].pop()
            count[gap] -= 1
        else:
            gap, sequence = size, self.made
            self.made += 1
        if gap > length:
            count[gap - length] += 1
            self.open[gap - length].append(sequence)
        return sequence, size - gap


def place_all(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the order given; what lies in sequences that stay open is placed anew while that saves any."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, opened, done = np.arange(len(lengths)), len(lengths) + 1, 0
    while len(left):
        packer = SumOfSquares(size)
        placed = np.array([packer.place(lengths[i]) for i in left], np.int64)
        if packer.made >= opened:
            break
        sequence[left], offset[left] = done + placed[:, 0], placed[:, 1]
        still = np.isin(placed[:, 0], [s for own in packer.open for s in own])
        opened = len(np.unique(placed[still, 0]))
        full, at = np.unique(placed[~still, 0], return_inverse=True)
        sequence[left[~still]] = done + at
        done += len(full)
        _, at = np.unique(placed[still, 0], return_inverse=True)
        left = left[still]
        sequence[left] = done + at
    return sequence, offset


def _pack(size: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["_group"]):
            for a, b in zip(starts, starts[1:]):
                own = table.slice(a, b - a).combine_chunks()
                sequence, offset = place_all(own.column("length").to_pylist(), size)
                sequence += own.column("_group")[0].as_py() << 32
                whole = own.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
                yield from whole.to_batches(max_chunksize=10_000)

    return run


def pack(pieces: DataFrame, size: int = 1024, group: int = 50_000) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32 and maybe ids) with ``sequence_id`` and ``offset``.

    ``pieces`` is read twice, so it should be a written table.  Lengths are from 1 to ``size``.
    """
    ship(pieces.sparkSession)
    columns = pieces.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    whole = F.col("length") >= size
    n = pieces.where(~whole).count()
    groups = max(1, -(-n // group))
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    dealt = (pieces.where(~whole).withColumn("_group", key).repartition(groups, "_group")
             .sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece", "ids_crc32"))
    packed = dealt.mapInArrow(_pack(size, columns), f"{kinds}, sequence_id long, offset long")
    alone = pieces.where(whole).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from pieces that carry theirs; a sequence is at most ``size`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """Cut and pack: one row per piece with its place.  Pieces are written to the shared folder in between, without texts."""
    pieces, _ = Staged(docs.sparkSession).table(cut(docs, vocabulary, end_id, size, with_ids))
    return pack(pieces, size)
