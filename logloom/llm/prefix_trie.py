"""Prefix trie of conversations, by truncation peeling.

Turns are numbered without gaps by a range sort.  A prefix is known by 128 bits: the exclusive or of a hash of (position, role, text) over its
turns, scanned in chunks, so a conversation of any length stays parallel.  Every conversation cut off after each of its turns, grouped by prefix,
is a node.  Nodes with the same members follow each other on one path; such a run is known by (smallest member, number of members), since members
only get fewer on the way down.

Peeling starts at the deepest ends: a run from which no other hangs is complete, loses all its turns at once (nothing can merge or end among
them) and is regrouped with all others at the node it hangs from.  Leaves and saved tokens add up there; a run whose last child has come is complete
in turn.  The rounds are as many as there are branchings and ends on one path, not turns.  Every round's table is written.

The digest of the conversations that end at a node is one hash over their sorted ids, so it is computed in order; sorted stretches are joined to
text before, in range partitions, and the last step only feeds stretches to the hash, in constant memory.

Defined results: turns are ordered by turn (null first), then role, then text; equal rows are turns of their own.  A null role or text is empty.
Rows without a conversation id belong to no conversation and are left out.  Conversations without turns count at the root, if ``conversations``
names them.  Texts of any length are hashed whole.  Without conversations the result is empty, without a root.  Other columns of the input are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.common import Staged, own_columns, ship
from logloom.operators.scans import CHUNK_LINES

NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = ["k1", "k2"]


def numbered(turns: DataFrame, staged: Staged, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position from 1, role, text), written.  Rows are sorted by ranges, and positions follow from one offset per conversation and
    partition.  Texts are compared inside a partition only, so the bounds of the ranges stay short."""
    rows = own_columns(turns, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id IS NOT NULL")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    laid = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    laid, _ = staged.table(laid.select("conv_id", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    spans = laid.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # A conversation is in several partitions only if it holds the bounds between them: the table of offsets has one row for each other one.
    offsets, _ = staged.table(spans.select("conv_id", "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    placed = laid.join(offsets, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("offset") + F.col("at") - F.col("start") + 1).alias("position"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent node, bytes, bytes up to here, last) of every cut of every conversation that has turns."""
    said = [F.col("position"), F.col("role"), F.col("text")]
    own = turns.select("conv_id", F.col("position").alias("depth"), F.xxhash64(*said).alias("t1"), F.xxhash64(F.lit(1), *said).alias("t2"),
                       F.octet_length("text").cast("long").alias("bytes")).withColumn("chunk", F.floor(F.col("depth") / CHUNK_LINES))
    sums = own.groupBy("conv_id", "chunk").agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"), F.sum("bytes").alias("bytes"), F.max("depth").alias("depth"))
    chunks = W.partitionBy("conv_id").orderBy("chunk")
    before, whole = chunks.rowsBetween(W.unboundedPreceding, -1), chunks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    starts = sums.select("conv_id", "chunk", *[F.coalesce(fold(c).over(before), zero).alias(f"p_{c}") for c, fold in (("t1", F.bit_xor), ("t2", F.bit_xor), ("bytes", F.sum))],
                         F.max("depth").over(whole).alias("length"))
    inside = W.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    cut = own.join(starts, ["conv_id", "chunk"]).select(
        "conv_id", "depth", "t1", "t2", "bytes", "length", *[F.bit_xor(t).over(inside).bitwiseXOR(F.col(f"p_{t}")).alias(k) for t, k in (("t1", "k1"), ("t2", "k2"))],
        (F.sum("bytes").over(inside) + F.col("p_bytes")).alias("upto"))
    return cut.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"),
                      "bytes", "upto", (F.col("depth") == F.col("length")).alias("last"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, id) rows as one row per node and batch: the ids as text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, ids = (batch.column(c).to_numpy() for c in range(3))
        starts = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(ids[starts]), pa.array(texts)], names=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its stretches, in order; one open hash at a time."""
    node, running = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (k1, k2) == node:
                running.update(b"," + ids.encode())
                continue
            if running:
                done.append((*node, running.hexdigest()))
            node, running = (k1, k2), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*NODE, "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, running.hexdigest())], names=[*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id) rows."""
    ship(ends.sparkSession)
    laid = ends.select(*NODE, F.col("conv_id").cast("long")).repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = laid.mapInArrow(_stretches, "k1 long, k2 long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def _peeled(runs: DataFrame, staged: Staged) -> DataFrame:
    """(conv_id, n_convs, n_children, n_leaves, below) of every run: the children of its last node, the leaves and the tokens saved below it.

    ``runs`` is written and has the run, its last node, the node it hangs from (a column of nulls for the root's), and its own tokens ``own``.
    """
    hang = runs.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.count("h1").alias("n_children")).where("k1 IS NOT NULL")
    state, at = staged.table(runs.join(hang, NODE, "left").select(
        "conv_id", "n_convs", *NODE, "h1", "h2", "own", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_children", F.lit(0)).alias("waiting"),
        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("below")))
    shown = ["conv_id", "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), "below"]
    complete = []
    while True:
        ready = state.where("waiting = 0")
        found, _ = staged.table(ready.select(*shown, "h1", "h2", (F.col("below") + F.col("own")).alias("saved")))
        if found.isEmpty():
            break
        complete.append(found.select("conv_id", "n_convs", "n_children", "n_leaves", "below"))
        gained = found.where("h1 IS NOT NULL").groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(
            F.count(F.lit(1)).alias("came"), F.sum("n_leaves").alias("new_leaves"), F.sum("saved").alias("new_saved"))
        left = state.where("waiting > 0").join(gained, NODE, "left").select(
            "conv_id", "n_convs", *NODE, "h1", "h2", "own", "n_children", (F.col("waiting") - F.coalesce("came", F.lit(0))).alias("waiting"),
            (F.col("leaves") + F.coalesce("new_leaves", F.lit(0))).alias("leaves"), (F.col("below") + F.coalesce("new_saved", F.lit(0))).alias("below"))
        was, (state, at) = at, staged.table(left)
        staged.drop(was)
    out = complete[0] if complete else state.select(*shown)
    for more in complete[1:]:
        out = out.unionAll(more)
    return out


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, staged: Staged | None = None) -> DataFrame:
    """A row per node from :func:`numbered` turns.  ``conversations`` (conv_id) are all conversations, those without turns included."""
    staged = staged or Staged(turns.sparkSession)
    cuts, _ = staged.table(prefixes(turns))
    named = cuts.where("depth = 1").select("conv_id")
    if conversations is not None:
        named = named.unionByName(own_columns(conversations, conv_id="conv_id").where("conv_id IS NOT NULL"))
    named, _ = staged.table(named.distinct())
    silent = named.join(cuts.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = named.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("bytes"), zero.alias("upto"))
    # Functions of the prefix, such as its bytes, are equal for all members, so any of them serves.
    nodes, _ = staged.table(cuts.select(roots.columns).unionAll(roots).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in ("depth", "p1", "p2", "bytes", "upto")]))
    bottom = F.struct("depth", *NODE, "upto")
    top = F.struct("depth", "p1", "p2", (F.col("upto") - F.col("bytes")).alias("before"))
    runs, _ = staged.table(nodes.groupBy("conv_id", "n_convs").agg(F.max(bottom).alias("b"), F.min(top).alias("t")).select(
        "conv_id", "n_convs", "b.k1", "b.k2", F.col("b.depth").alias("bottom"), F.col("t.depth").alias("top"), F.col("t.p1").alias("h1"), F.col("t.p2").alias("h2"),
        F.col("b.upto").alias("all"), ((F.col("n_convs") - 1) * (F.col("b.upto") - F.col("t.before"))).alias("own")))
    above = runs.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("conv_id").alias("parent"))
    peeled = _peeled(runs, staged).join(runs.select("conv_id", "n_convs", "bottom", "top", "all", "h1", "h2"), ["conv_id", "n_convs"]).join(above, ["h1", "h2"], "left")
    peeled, _ = staged.table(peeled.drop("h1", "h2"))
    ended = cuts.where("last").select(*NODE, "conv_id").unionAll(silent.select(zero, zero, "conv_id"))
    digests, _ = staged.table(end_digests(ended))
    whole = nodes.join(peeled, ["conv_id", "n_convs"]).join(digests, NODE, "left")
    saved = F.col("below") + (F.col("n_convs") - 1) * (F.col("all") - F.col("upto") + F.col("bytes"))
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") < F.col("bottom"), 1).otherwise(F.col("n_children")).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
