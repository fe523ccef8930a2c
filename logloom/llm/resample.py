"""Target-distribution importance resampling: draw the share of documents that looks most like a target, by Gumbel top-k.

Features are the words and word pairs of whole texts, hashed to buckets by CRC-32.  Bucket counts of both tables add up in tasks, so at most one row a
bucket and task is shuffled and one row a bucket reaches the driver.  Weights come from numpy arrays: the checksums of all words of a slice advance
together, byte by byte, and a pair goes on from its first word's state.

The cutoff of the draw is found by weighted median of medians.  Every partition of the written keys gives the median of what remains on each side of
the last pivot and how much that is; the median of these medians, weighted by the sizes, is the next pivot, and the side that cannot hold the
cutoff, a guaranteed quarter at least, is discarded.  The search ends with the exact cutoff key; only the winners are sorted.

Defined results: null, empty and word-less texts have no features, weight 0 and a score like any other.  Equal scores go to the smaller id, then the
smaller weight and feature count; a row without an id comes last among equal scores, its noise that of an empty id.  Repeated rows are rows: each
counts, has the same score and can be drawn.  Texts of any length are taken whole, in slices that end between words.  Empty tables give
empty results; an empty target leaves the smoothed weights.  Other columns of the input come back in a struct ``carried``, if asked for.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logloom.llm.common import SLICE, Staged, own_columns, ship, slices
from logloom.operators.scans import ranked

#: A-Z are lower-cased, and all ASCII but digits and lower letters stands between words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[97:123] = BETWEEN[128:] = False

#: Words longer than this have their checksum computed one by one.
LONG_WORD = 64

FIRST_STATE = 0xFFFFFFFF


@dataclass(frozen=True)
class Draw:
    """``buckets`` bounds what the driver gathers of each table; ``percent`` of the rows with ``least_words`` words or more are drawn."""

    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7
    scale: int = 1000


def _table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1).astype(np.uint32)
    return rows


TABLE = _table()


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksum states after the words at ``starts``, one byte of all words at a time."""
    out = state.copy()
    short = lengths <= LONG_WORD
    for i in np.flatnonzero(~short):
        word = data[starts[i]:starts[i] + lengths[i]].tobytes()
        out[i] = zlib.crc32(word, int(out[i]) ^ FIRST_STATE) ^ FIRST_STATE
    order = np.flatnonzero(short)
    order = order[np.argsort(-lengths[order], kind="stable")]
    at, now, left = starts[order], out[order], lengths[order]
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, "left"))  # words longer than ``step``
        now[:n] = TABLE[(now[:n] ^ data[at[:n] + step]) & 0xFF] ^ (now[:n] >> 8)
    out[order] = now
    return out


@dataclass
class Part:
    """Features of a slice: the bucket and the row of each, and the words by row.  ``state`` is that of the last word."""

    buckets: np.ndarray
    rows: np.ndarray
    words: np.ndarray
    state: int | None


def _features(data: np.ndarray, ends: np.ndarray, buckets: int, before: int | None = None) -> Part:
    """Words and pairs of the texts that end at ``ends`` in lower-cased ``data``; ``before`` is the state of the word before the first text."""
    inside = ~BETWEEN[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    new[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    starts, stops = np.flatnonzero(new), np.flatnonzero(last) + 1
    rows = np.searchsorted(ends, starts, "right")
    single = _advance(np.full(len(starts), FIRST_STATE, np.uint32), data, starts, stops - starts)
    if not len(starts):
        return Part(np.zeros(0, np.int64), rows, np.zeros(len(ends), np.int64), before)
    previous = np.empty_like(single)
    previous[1:] = single[:-1]
    follows = np.zeros(len(starts), bool)
    follows[1:] = rows[1:] == rows[:-1]
    if before is not None:
        previous[0], follows[0] = before, rows[0] == 0
    space = TABLE[(previous[follows] ^ np.uint32(32)) & 0xFF] ^ (previous[follows] >> 8)
    pairs = _advance(space, data, starts[follows], (stops - starts)[follows])
    states = np.concatenate([single, pairs]) ^ np.uint32(FIRST_STATE)
    return Part((states % buckets).astype(np.int64), np.concatenate([rows, rows[follows]]), np.bincount(rows, minlength=len(ends)), int(single[-1]))


def _parts(batch: pa.RecordBatch, text: int, buckets: int) -> Iterator[tuple[int, Part]]:
    """(row of the batch where the part begins, part) of all texts; a text beyond a slice comes in several parts of one row."""
    start = 0
    for piece in slices(batch, batch.schema.names[text]):
        column = piece.column(text).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        if len(data) <= 2 * SLICE:
            yield start, _features(LOWER[data], offsets[1:] - offsets[0], buckets)
        else:  # one row
            at, state = 0, None
            while at < len(data):
                stop = min(len(data), at + SLICE)
                while stop < len(data):  # the slice ends between words
                    gaps = np.flatnonzero(BETWEEN[LOWER[data[stop:stop + SLICE]]])
                    stop = stop + int(gaps[0]) if len(gaps) else min(len(data), stop + SLICE)
                    if len(gaps):
                        break
                part = _features(LOWER[data[at:stop]], np.array([stop - at]), buckets, state)
                yield start, part
                at, state = stop, part.state
        start += piece.num_rows


def bucket_counts(texts: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; ``buckets`` numbers reach the driver."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _parts(batch, 0, buckets):
                total += np.bincount(part.buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    parts = own_columns(texts, text=text).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas().itertuples(index=False):
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Scaled logarithm of how much more frequent each bucket is in the target, rounded down."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: str, seed: int = 7, scale: int = 1000) -> int:
    """Gumbel noise that depends on the id and the seed alone."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-scale * np.log(-np.log((h + 0.5) / 4294967296))))


def scored(docs: DataFrame, weights: np.ndarray, plan: Draw, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every row, and ``carried``."""
    ship(docs.sparkSession)
    buckets, seed, scale = plan.buckets, plan.seed, plan.scale
    ids = docs.schema[doc_id].dataType
    rows = docs.select(docs[f"`{text}`"].alias("text"), docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{doc_id}`"].cast("string").alias("name"),
                       *([F.struct(*[docs[f"`{c}`"] for c in carry]).alias("carried")] if carry else []))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for start, part in _parts(batch, 0, buckets):
                span = slice(start, start + len(part.words))
                words[span] += part.words
                n[span] += np.bincount(part.rows, minlength=len(part.words))
                total[span] += np.bincount(part.rows, weights[part.buckets], minlength=len(part.words)).astype(np.int64)
            weight = total // np.maximum(n, 1)
            drawn = np.array([noise(x or "", seed, scale) for x in batch.column(2).to_pylist()], np.int64)
            new = [pa.array(x) for x in (n, words, weight, weight + drawn)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *new, *batch.columns[3:]], names=["doc_id", "n_features", "n_words", "weight", "score", *batch.schema.names[3:]])

    numbers = [StructField(c, LongType()) for c in ("n_features", "n_words", "weight", "score")]
    schema = StructType([StructField("doc_id", ids), *numbers, *([rows.schema["carried"]] if carry else [])])
    return rows.mapInArrow(score, schema)


def _key() -> dict[str, Column]:
    """The key of the draw as integers, the best first in ascending order."""
    return {"k0": -F.col("score"), "k1": F.col("doc_id").isNull().cast("long"), "k2": F.coalesce("doc_id", F.lit(0)).cast("long"),
            "k3": F.col("weight"), "k4": F.col("n_features")}


def _beside(key: list[Column], pivot: tuple[int, ...], below: bool) -> Column:
    """Rows strictly below, or strictly above, a pivot."""
    out, same = F.lit(False), F.lit(True)
    for part, value in zip(key, pivot):
        out = out | (same & ((part < value) if below else (part > value)))
        same = same & (part == value)
    return out


def cutoff(keys: DataFrame, k: int) -> tuple[int, ...]:
    """The k-th smallest key of a written table (k from 1), by weighted median of medians over its partitions.

    A round is one pass over the keys that can still be the cutoff: every partition answers, for the keys below and above the last pivot, with
    their number and their median.  Only these few numbers a partition reach the driver.
    """
    names = keys.columns
    width = len(names)

    def summarize(pivot):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)]) for b in batches if b.num_rows]
            if not held:
                return
            rows = np.concatenate(held, 1)
            less, same = np.zeros(rows.shape[1], bool), np.ones(rows.shape[1], bool)
            for row, value in zip(rows, pivot or ()):
                less |= same & (row < value)
                same &= row == value
            if pivot is None:
                same[:] = False
            for side, which in ((0, less), (1, same), (2, ~less & ~same)):
                mine = rows[:, which]
                n = mine.shape[1]
                if n:
                    middle = mine[:, np.lexsort(mine[::-1])[(n - 1) // 2]] if side != 1 else mine[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (side, n, *middle.tolist())], names=["side", "n", *names])
        return run

    ship(keys.sparkSession)
    key = [F.col(c) for c in names]
    low = high = F.lit(True)
    remaining, pivot = keys, None
    while True:
        answers = remaining.mapInArrow(summarize(pivot), ", ".join(f"{c} long" for c in ("side", "n", *names))).toArrow().to_pylist()
        sizes = [sum(x["n"] for x in answers if x["side"] == side) for side in range(3)]
        if pivot is not None and sizes[0] < k <= sizes[0] + sizes[1]:
            return pivot
        side = 0 if k <= sizes[0] else 2
        if side == 2:
            k -= sizes[0] + sizes[1]
        medians = sorted((tuple(x[c] for c in names), x["n"]) for x in answers if x["side"] == side)
        if pivot is not None:
            low, high = (low, _beside(key, pivot, True)) if side == 0 else (_beside(key, pivot, False), high)
            remaining = keys.where(low & high)
        half, run = sum(n for _, n in medians) / 2, 0
        for pivot, n in medians:
            run += n
            if run >= half:
                break


def resample(docs: DataFrame, target: DataFrame, plan: Draw = Draw(), doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row's ``doc_id`` (an integer), ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn), and ``carried``."""
    staged = Staged(docs.sparkSession)
    weights = gains(bucket_counts(docs, text, plan.buckets), bucket_counts(target, target_text, plan.buckets), plan.scale)
    table, _ = staged.table(scored(docs, weights, plan, doc_id, text, carry))
    able = F.col("n_words") >= plan.least_words
    k = plan.percent * table.where(able).count() // 100
    shown = ["doc_id", "n_features", "weight", "score", *(["carried"] if carry else [])]
    if not k:
        return table.select(*shown[:4], F.lit(None).cast("long").alias("rank"), *shown[4:])
    key = _key()
    last = cutoff(table.where(able).select(*[c.alias(name) for name, c in key.items()]), k)
    winner = able & ~_beside(list(key.values()), last, False)
    # Rows equal to the cutoff in every part of the key may be more than are left to draw.
    first = ranked(table.where(winner), [], list(key.values())).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")).cast("long"))
    rest = table.where(~winner).withColumn("rank", F.lit(None).cast("long"))
    return first.select(*shown[:4], "rank", *shown[4:]).unionByName(rest.select(*shown[:4], "rank", *shown[4:]))
