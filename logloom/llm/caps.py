"""Embedding near-dedup with spherical-cap filters from structured random product codes.

Filter directions are all products of one short code per block of randomly rotated components: ``codes ** parts`` directions from
``codes * parts`` random vectors, in ``tables`` rotations.  A vector is list-decoded to every direction whose inner product with it exceeds a
threshold: partial sums of half of the blocks are kept only where the best of the other half can still lift them over it.  Vectors
that share a filter (and their group) meet there; each pair is verified by its exact cosine in double precision, so nothing below
the threshold is linked.

The threshold is the one that random vectors exceed for ``mean_list`` directions a rotation on average.  A pair is missed where none of the
directions is shared; for pairs just above cosine 0.98 that is under one in a hundred (tests/llm measures it in 16 and 64 dimensions).

Equal vectors of a group are one vector with a count.  A filter with more vectors than ``block`` is dealt into pairs of blocks.  A pair that
meets in several filters counts in the first that both have.  Each block reports sums of links and a spanning forest, never pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with nothing;
vectors of unequal length do not link; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Staged, matrix, own_columns, paired_blocks, ship, whole_groups
from logloom.llm.components import connected_components


class CapFilters:
    """The directions for vectors of one length: ``tables`` rotations, each with ``codes`` ** ``parts`` products."""

    def __init__(self, width: int, tables: int = 4, parts: int = 2, codes: int = 256, mean_list: float = 16, seed: int = 7):
        rng = np.random.default_rng([seed, width])
        inner = -(-width // parts) * parts
        codes = min(codes, 4 ** (inner // parts))  # few components need few directions
        self.parts, self.codes = parts, codes
        self.turns = [np.linalg.qr(rng.normal(size=(inner, inner)))[0][:width] for _ in range(tables)]
        own = rng.normal(size=(parts, inner // parts, codes))
        self.own = own / np.linalg.norm(own, axis=1, keepdims=True) / np.sqrt(parts)
        trial = rng.normal(size=(64, width))
        trial = self._scores(trial / np.linalg.norm(trial, axis=1, keepdims=True), self.turns[0])
        sums = self._sums(trial).ravel()
        highest = min(len(sums), max(1, int(mean_list * len(trial))))
        self.threshold = min(np.partition(sums, -highest)[-highest], 0.9)  # a cap is wider than the angle of a link

    def _scores(self, unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return np.einsum("npd,pdc->npc", (unit @ turn).reshape(len(unit), self.parts, -1), self.own)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of ``unit`` the ascending numbers of all directions above the threshold."""
        out: list[list] = [[] for _ in unit]
        for table, turn in enumerate(self.turns):
            scores = self._scores(unit, turn)
            half = self.parts // 2
            left, right = self._sums(scores[:, :half]), self._sums(scores[:, half:])
            for row, a, b, most in zip(out, left, right, right.max(1)):
                first = np.flatnonzero(a >= self.threshold - most)
                i, j = np.nonzero(a[first, None] + b[None, :] >= self.threshold)
                row.append(np.sort((table * a.size + first[i]) * b.size + j))
        return [np.concatenate(x) for x in out]

    def _sums(self, scores: np.ndarray) -> np.ndarray:
        total = scores[:, 0]
        for p in range(1, scores.shape[1]):
            total = (total[:, :, None] + scores[:, p, None, :]).reshape(len(scores), -1)
        return total


_MADE: dict = {}


def _filters(width: int, options: tuple) -> CapFilters:
    if (width, options) not in _MADE:
        _MADE[width, options] = CapFilters(width, **dict(options))
    return _MADE[width, options]


def _decode(options: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists: list = [None] * part.num_rows
                widths = np.array([len(x) for x in part.column("embedding")])
                for width in np.unique(widths):
                    at = np.flatnonzero(widths == width)
                    x = matrix(part.column("embedding").take(pa.array(at))).astype(np.float64)
                    x /= np.abs(x).max(1, keepdims=True)
                    for i, found in zip(at, _filters(int(width), options).decode(x / np.linalg.norm(x, axis=1, keepdims=True))):
                        lists[i] = found
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(lists, pa.list_(pa.int64()))], names=["node", "filters"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric link matrix."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            near = np.zeros(len(linked), bool)
            near[i] = True
            size = 0
            while (now := near.sum()) > size:
                size = now
                near |= linked[near].any(0)
            root[near] = i
    return root


def _verify(least: float):
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["_key", "filter", "_lo", "_hi"]):
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            filters, part = table.column("filter").to_numpy(), table.column("_part").to_numpy()
            lo, hi = table.column("_lo").to_numpy(), table.column("_hi").to_numpy()
            vectors, lists = table.column("embedding").combine_chunks(), table.column("filters").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            out: list[list] = [[], [], []]
            for a, b in zip(starts, starts[1:]):
                if b - a < 2:
                    continue
                raw = matrix(vectors.slice(a, b - a)).astype(np.float64)
                x = raw / np.abs(raw).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                linked = x @ x.T >= least - 1e-9
                np.fill_diagonal(linked, False)
                if lo[a] != hi[a]:
                    linked &= part[a:b, None] != part[None, a:b]
                if not linked.any():
                    continue
                for i, j in zip(*np.nonzero(np.triu(linked & (x @ x.T < least + 1e-9)))):  # too close to call above
                    u, v = raw[i], raw[j]
                    linked[i, j] = linked[j, i] = (u @ v) / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= least
                rows = np.repeat(np.arange(b - a), np.diff(ends[a: b + 1]))
                own = flat[ends[a] - ends[0]: ends[b] - ends[0]]
                before = own < filters[a]
                _, column = np.unique(own[before], return_inverse=True)
                has = np.zeros((b - a, column.max(initial=-1) + 1), np.float32)
                has[rows[before], column] = 1
                first = linked & (has @ has.T == 0)
                links, root = first.astype(np.int64) @ copies[a:b], _forest(linked)
                keep = np.flatnonzero(linked.any(1))
                for column_out, value in zip(out, (node[a + keep], node[a + root[keep]], links[keep])):
                    column_out.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, block: int = 2048, **filters) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``; links only within equal, non-null labels.

    Reads ``vec_id``, ``embedding`` and ``label``.  ``filters``: tables, parts, codes, mean_list and seed of ``CapFilters``.
    """
    spark = vectors.sparkSession
    ship(spark)
    staged, options = Staged(spark), tuple(sorted(filters.items()))
    rows = own_columns(vectors, vec_id="vec_id", embedding="embedding", label="label").withColumn("rid", F.monotonically_increasing_id())
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    rows, _ = staged.table(rows.withColumn("usable", F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True))))
    usable = rows.where("usable")
    nodes, _ = staged.table(usable.groupBy("label", "embedding").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("copies"))
                            .withColumn("_key", F.xxhash64("label", F.size("embedding"))))
    lists, _ = staged.table(nodes.select("node", "embedding").mapInArrow(_decode(options), "node long, filters array<long>"))
    entries = (nodes.select("node", "_key").join(lists, "node").select("node", "_key", F.explode("filters").alias("filter")))
    shared = entries.groupBy("_key", "filter").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = paired_blocks(entries.join(shared, ["_key", "filter"]), "_n", "node", block)
    full = met.join(nodes.select("node", "embedding", "copies"), "node").join(lists, "node")
    key = ["_key", "filter", "_lo", "_hi"]
    laid = full.select(*key, "_part", "node", "copies", "embedding", "filters").repartition(*key).sortWithinPartitions(*key, "node")
    found, _ = staged.table(laid.mapInArrow(_verify(least), "node long, root long, links long"))
    groups = connected_components(found, "node", "root", staged)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.join(links, "node", "left").join(groups, "node", "left").select(
        "node", "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    members = usable.join(per_node, ["label", "embedding"]).select("rid", "vec_id", "n_links", "component")
    smallest = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = members.join(smallest, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
