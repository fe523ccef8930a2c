"""SimHash near-dedup with BK-trees.

A fingerprint sums up the XXH64 hashes of a text's word shingles, bit by bit; more lanes of 64 bits come from mixing the same hashes anew.
Fingerprints meet in shards: each table of the plan takes some bits as a key, and the fingerprints of a key form a shard.  Each shard
gets a BK-tree, in which only edges within the radius are followed.  Trees reach the queries of their shard in one shuffle, not through the driver,
which could not hold the trees of a whole corpus; a shard of more than ``block`` fingerprints is dealt into trees of that size,
and every part of the shard is searched in each of them.  A task reports a spanning forest of its links, never pairs.

* ``exact_plan(radius)``: 64 bits in radius + 1 pieces.  Fingerprints that differ in ``radius`` bits or fewer agree on one piece, so no link is lost.
* ``similar_plan()``: links texts whose sets of shingles have a Jaccard similarity of 0.8 or more.  Fingerprints only name the candidates: those
  of a pair at 0.8 differ in about 15 % of their bits, so one of 64 keys of 16 bits from 16 lanes is equal with a probability of 0.99, and up
  to 68 of 256 bits may differ.  Each candidate is then judged by the exact similarity of the two sets, as 64-bit hashes.

Candidates of a set plan are never listed either: shards report a spanning forest of them, whose components are clusters.  A cluster is brought together
once, with its sets, in blocks as above; there the candidates of nodes that are still apart are judged, and again a spanning forest of links comes out.
So rows grow with the nodes, also in a group of texts that are all alike but under the similarity, of which each pair has to be judged.

Defined results: a text is split at ASCII white space after lower-casing A-Z; a text with fewer words than a shingle is one shingle; a null or
empty text has the fingerprint zero, no shingles, and links like any other.  Equal fingerprints (in a set plan: equal sets) are one node, so copies
cost nothing.  Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from logloom.llm.bktree import BKForest
from logloom.llm.common import SLICE, Staged, aside, own_columns, ship, slices, whole_groups
from logloom.llm.components import connected_components


#: Hashes of the filter that tells the texts of clusters from the others.
SLOTS = 1 << 20
#: Shingles that count as a node where a cluster is dealt into parts, so that long texts make more of them.
LONG = 1024


@dataclass(frozen=True)
class Plan:
    """Shingle length, lanes, key fields (lane, shift, bits), and how many of the lanes judge a pair within how many bits.

    With ``jaccard`` (numerator, denominator) fingerprints are those of shingle sets, and links need that similarity of the sets.
    """

    words: int
    lanes: int
    keys: tuple[tuple[int, int, int], ...]
    judged: int
    radius: int
    jaccard: tuple[int, int] | None = None


def exact_plan(words: int = 3, radius: int = 2) -> Plan:
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return Plan(words, 1, tuple((0, a, b - a) for a, b in zip(edges, edges[1:])), 1, radius)


def similar_plan(words: int = 5, lanes: int = 16, bits: int = 16, judged: int = 4, radius: int = 68) -> Plan:
    return Plan(words, lanes, tuple((lane, shift, bits) for lane in range(lanes) for shift in range(0, 65 - bits, bits)), judged, radius, (4, 5))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)))), repeat(42)), np.uint64, len(w) - words + 1)


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """A bit is 1 if it is set in over half of the hashes; no hashes give zero."""
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    total = np.zeros(64 * lanes, np.int64)
    for lo in range(0, len(hashes), 1 << 13):
        some = hashes[lo: lo + (1 << 13)]
        rows = np.stack([_mixed(some, lane) for lane in range(lanes)], axis=1)
        total += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def _fingerprints(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            prints, names = np.zeros((n, plan.lanes), np.uint64), np.zeros((n, 3), np.int64)
            for i, text in enumerate(batch.column("text")):
                hashes = shingle_hashes(text.as_py(), plan.words)
                if plan.jaccard:
                    hashes = np.unique(hashes)
                    names[i] = *np.frombuffer(xxh3_128_digest(hashes.tobytes()), np.int64), len(hashes)
                prints[i] = fingerprint(hashes, plan.lanes)
            own = ["doc_id", "_r1", "_r2"]
            columns = [*map(batch.column, own), *(pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(plan.lanes))]
            if plan.jaccard:
                columns += [pa.array(np.ascontiguousarray(names[:, i])) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *_lanes(plan.lanes), *_sets(plan)])

    return run


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _lanes(n: int) -> list[str]:
    return [f"f{i}" for i in range(n)]


def _sets(plan: Plan) -> list[str]:
    """128 bits that name a shingle set, and its size."""
    return ["s1", "s2", "n"] if plan.jaccard else []


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, _r1, _r2, f0, f1, ...) of every whole text; lanes are signed 64-bit numbers, _r1 and _r2 name the row.

    For a set plan also s1 and s2, which name the set of shingles, and n, its size.
    """
    ship(docs.sparkSession)
    rows = own_columns(docs, doc_id="doc_id", text="text").withColumns(_row_keys("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(plan), f"doc_id {kind}, _r1 long, _r2 long, " + ", ".join(f"{x} long" for x in [*_lanes(plan.lanes), *_sets(plan)]))


def _met(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[tuple[pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Tables of whole blocks, with the pairs of their rows within the radius.  ``_role`` tells whether a row is asked for (1), held in the tree (2) or both."""
    for table, starts in whole_groups(batches, ["_block"]):
        prints = np.stack([table.column(x).to_numpy().view(np.uint64) for x in _lanes(plan.judged)], axis=1)
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        role = table.column("_role").to_numpy()
        held, asked = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        asked = asked[np.isin(group[asked], group[held])]
        trees, of_tree = np.unique(group[held], return_inverse=True)
        found = BKForest(prints[held], of_tree).search(prints[asked], np.searchsorted(trees, group[asked]), plan.radius) if len(held) else ()
        yield table, ((asked[query], held[node]) for query, node in found)


def _search(plan: Plan):
    """A spanning forest of each block's links; in a set plan, of its candidates."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pairs in _met(batches, plan):
            label = np.arange(table.num_rows)
            for a, b in pairs:
                if plan.jaccard:
                    able = _sized(plan, table.column("n").to_numpy(), a, b)
                    a, b = a[able], b[able]
                label = _merged(label, a, b)
            yield from _forest(table, label, schema)

    return run


def _links(plan: Plan):
    """A spanning forest of the links in each block of a set plan: candidates of rows that are still apart are judged by their sets."""
    schema, (over, under) = pa.schema([("node", pa.int64()), ("root", pa.int64())]), plan.jaccard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, pairs in _met(batches, plan):
            label, role, size = np.arange(table.num_rows), *(table.column(x).to_numpy() for x in ("_role", "n"))
            lanes = np.stack([table.column(x).to_numpy().view(np.uint64) for x in _lanes(plan.lanes)], axis=1)
            _, words = np.unique(table.column("shingles").combine_chunks().flatten().to_numpy(), return_inverse=True)
            ends = np.cumsum(size)
            for a, b in pairs:
                able = (label[a] != label[b]) & ((a < b) | (role[a] != role[b])) & _sized(plan, size, a, b)
                a, b = a[able], b[able]
                met = _meet(plan, lanes, a, b)
                a, b = a[met], b[met]
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                total, lo = np.cumsum(size[b]), 0
                while lo < len(a):  # in slices, so that what one has joined need not be judged in the next
                    hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, "right")))
                    x, y = a[lo:hi], b[lo:hi]
                    still = label[x] != label[y]
                    x, y = x[still], y[still]
                    good = (over + under) * _shared(words, ends, size, x, y) >= over * (size[x] + size[y])
                    label = _merged(label, x[good], y[good])
                    lo = hi
            yield from _forest(table, label, schema)

    return run


def _meet(plan: Plan, lanes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two rows are in one shard of any key, and so a candidate."""
    met = np.zeros(len(a), bool)
    for lane, shift, bits in plan.keys:
        own = lanes[:, lane] >> np.uint64(shift) & np.uint64((1 << bits) - 1)
        met |= own[a] == own[b]
    return met


def _sized(plan: Plan, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sets of too different a size cannot be similar enough."""
    over, under = plan.jaccard
    return under * np.minimum(size[a], size[b]) >= over * np.maximum(size[a], size[b])


def _shared(words: np.ndarray, ends: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the sets of the rows a and b share, pair by pair; ``a`` is sorted, and no set of ``b`` is empty.

    ``words`` holds the sets one after the other, shingles numbered from 0; ``ends`` is where they end.
    """
    shared, held = np.empty(len(a), np.int64), np.zeros(int(words.max(initial=-1)) + 1, bool)
    first = np.flatnonzero(np.diff(a, prepend=-1))
    for lo, hi in zip(first, [*first[1:], len(a)]):
        own = words[ends[a[lo]] - size[a[lo]]: ends[a[lo]]]
        held[own] = True
        n = size[b[lo:hi]]
        start = np.cumsum(n) - n
        found = held[words[np.repeat(ends[b[lo:hi]] - n - start, n) + np.arange(n.sum())]]
        shared[lo:hi] = np.add.reduceat(found.view(np.uint8), start, dtype=np.int64)
        held[own] = False
    return shared


def _forest(table: pa.Table, label: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, nodes = np.flatnonzero(label != np.arange(len(label))), table.column("node").to_numpy()
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array(nodes[label[rows]])], schema=schema)


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (row numbers, smallest of each component so far) after the links a - b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _key(plan: Plan, i: int) -> Column:
    lane, shift, bits = plan.keys[i]
    field = F.shiftrightunsigned(F.col(f"f{lane}"), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return F.lit(i << 40).cast("long") + field


def _laid(nodes: DataFrame, plan: Plan, block: int, staged: Staged) -> DataFrame:
    """Narrow copies of the nodes in the order of their shards, each with the id of its block and its role there.

    Only the keys of more than ``block`` nodes, which are few, are joined and dealt into pairs of parts; all others are blocks as they are.
    """
    keys = F.explode(F.array(*[_key(plan, i) for i in range(len(plan.keys))])).alias("_key")
    columns = ["node", *_lanes(plan.judged), *(["n"] if plan.jaccard else [])]
    counts = nodes.select(keys).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    crowded, _ = staged.table(counts.where(F.col("_n") > block))
    return _blocks(nodes.select(*columns, keys).join(crowded, "_key", "left"), block, *columns)


def _blocks(copies: DataFrame, block: int, *columns: str) -> DataFrame:
    """Rows in the order of their blocks: those of a ``_key``, or of two parts of it where ``_n``, its size, is not null."""
    parts = F.ceil(F.col("_n") / block).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    other = F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))).alias("_with")
    met = copies.withColumn("_part", part).select("*", other)
    low, high = F.least("_part", "_with"), F.greatest("_part", "_with")
    role = F.when(F.col("_n").isNull() | (low == high), 3).when(F.col("_part") == low, 2).otherwise(1).cast("long")
    name = F.when(F.col("_n").isNull(), F.col("_key")).otherwise(F.xxhash64("_key", low, high))
    return met.select(name.alias("_block"), role.alias("_role"), *columns).repartition("_block").sortWithinPartitions("_block", "node")


def _set_links(rows: DataFrame, nodes: DataFrame, plan: Plan, block: int, staged: Staged) -> DataFrame:
    """(node, root): links between nodes by the exact similarity of their sets; ``rows`` holds the texts under the row keys."""
    near, near_at = staged.table(_laid(nodes, plan, block, staged).mapInArrow(_search(plan), "node long, root long").distinct())
    clusters = connected_components(near, "node", "root", staged).withColumnRenamed("component", "_key")
    some, some_at = staged.table(nodes.join(clusters, "node"))
    staged.drop(near_at)
    # Most texts are in no cluster.  A filter of hashes, whose size is bounded, keeps them out of the shuffle; the join after it is exact.
    slot = F.pmod("_r1", F.lit(SLOTS)).alias("_slot")
    asked = F.broadcast(some.select(slot).distinct())
    texts = rows.select("*", slot).join(asked, "_slot", "left_semi").join(some.select("node", "_r1", "_r2"), ["_r1", "_r2"]).select("node", "text")
    sets = texts.mapInArrow(_shingle_sets(plan.words), "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    counts = some.groupBy("_key").agg(F.greatest(F.count(F.lit(1)), F.sum("n") / LONG).alias("_n"))
    crowded, _ = staged.table(counts.where(F.col("_n") > block))
    columns = ["node", *_lanes(plan.lanes), "n", "shingles"]
    laid = _blocks(some.join(sets, "node").select("_key", *columns).join(crowded, "_key", "left"), block, *columns)
    links, _ = staged.table(laid.mapInArrow(_links(plan), "node long, root long"))
    staged.drop(some_at)
    return links


def near_duplicates(docs: DataFrame, plan: Plan | None = None, block: int = 4096) -> DataFrame:
    """(doc_id, _r1, _r2, f0, ..., component_id, first): one row per document; component_id is the smallest doc_id reachable by links.

    ``first`` marks one row of each component, also where ids repeat or are null.  Reads ``doc_id`` (a whole number) and ``text``.
    """
    plan, spark = plan or exact_plan(), docs.sparkSession
    staged, lanes = Staged(spark), _lanes(plan.lanes)
    prints, _ = staged.table(fingerprints(docs, plan).withColumn("rid", F.monotonically_increasing_id()))
    if plan.jaccard:
        same = ["s1", "s2"]
        one = prints.groupBy(*same, "n", *lanes).agg(F.min(F.struct("rid", "_r1", "_r2")).alias("_one"))
        nodes, _ = staged.table(one.select(*same, "n", *lanes, F.col("_one")["rid"].alias("node"), "_one._r1", "_one._r2"))
        rows = own_columns(docs, doc_id="doc_id", text="text").withColumns(_row_keys("doc_id", "text"))
        groups = connected_components(_set_links(rows, nodes, plan, block, staged), "node", "root", staged)
    else:
        same = lanes
        nodes, _ = staged.table(prints.groupBy(*lanes).agg(F.min("rid").alias("node")))
        found, _ = staged.table(_laid(nodes, plan, block, staged).mapInArrow(_search(plan), "node long, root long"))
        groups = connected_components(found, "node", "root", staged)
    of_print = nodes.join(groups, "node", "left").select(*same, F.coalesce("component", "node").alias("_c"))
    members = prints.join(of_print, same)
    smallest = of_print.join(prints, same).groupBy("_c").agg(F.min("doc_id").alias("component_id"), F.min_by("rid", F.struct("doc_id", "rid")).alias("_first"))
    return members.join(smallest, "_c").select("doc_id", "_r1", "_r2", *lanes, "component_id", (F.col("rid") == F.col("_first")).alias("first"))


def _row_keys(doc_id: str, text: str) -> dict[str, Column]:
    """128 bits that name a row by its id and whole text."""
    return {"_r1": F.xxhash64(doc_id, text), "_r2": F.xxhash64(F.lit(1), text, doc_id)}


def deduplicated(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id; columns are unchanged.

    Rows are matched by id and whole text; of repeated rows one stays.
    """
    first = near_duplicates(docs, plan or similar_plan()).where("first").select("_r1", "_r2")
    once = F.row_number().over(W.partitionBy("_r1", "_r2").orderBy("_r1"))
    placed = aside(docs, "doc_id", "text")
    kept = placed.withColumns(_row_keys("doc_id", "text")).join(first, ["_r1", "_r2"])
    return kept.withColumn("_once", once).where("_once = 1").select(*placed.columns).toDF(*docs.columns)
