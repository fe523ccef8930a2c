"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's components are dealt into ``lists`` score lists, and a task holds one list: the partial scores of a block of queries with a block of
candidates.  No task sees a whole score.

1. Each list reports, per query, the ``gather`` * ``k`` candidates with the highest partial scores in it.  The exact scores of these few are looked up; the
   k-th best of a query is its cut-off, which at least ``k`` candidates reach.
2. The cut-offs are broadcast.  A candidate whose partial score is below cut-off / lists in every list cannot reach the cut-off, so each list gives only
   its entries at or above that.  A candidate goes if what was seen of it, and less than the threshold for each list that did not give it, stay below the cut-off.
3. The scores of what is left, and only of that, are resolved exactly, and a rank over these and the first ones ends it.  Pairs travel to the vectors of
   their block as two numbers, and a block gives the ``k`` best of each query.

Of equal vectors only the ``k`` + 1 smallest ids can be among the ``k`` best of anything, so no more of them are candidates; a vector that a third of the rows
share is a candidate ``k`` + 1 times.  Cut-offs are one number a query; more than ``BROADCAST`` of them are joined by a shuffle.

Components become floor(scale * x).  Totals are exact integers, kept within 64 bits.

Defined results: vectors that are null or hold null or non-finite components take no part; of two vectors of unequal length, the
shorter one counts as zero where it ends (an empty one scores 0), and only rows as long as that are widened; a row is never its own candidate, but a
repeated row is; ties go to the smaller id, null ids last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.common import Staged, ship

_LIMIT = 2**63 - 1
#: Components that are multiplied at once, and queries whose partial scores are looked through at once.
SLAB, LOOK = 1024, 256
#: Pairs that are scored at once.
PAIRS = 4096
#: Cut-offs (16 bytes each) that are broadcast.
BROADCAST = 1_000_000

_PARTIAL = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("list", pa.int32()), ("partial", pa.float64())])
_PARTIALS = "q long, c long, list int, partial double"


def _flat(column: pa.ChunkedArray | pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of all components as doubles that hold integers, and the lengths of the rows."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale), np.diff(rows.offsets.to_numpy())


def _whole(values: np.ndarray) -> np.ndarray:
    """As Python integers, where doubles are too short."""
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def _slab(values: np.ndarray, lengths: np.ndarray, rows: np.ndarray, lo: int, hi: int, short: bool) -> np.ndarray:
    """Components ``lo`` to ``hi`` of some rows, zero where a row has ended."""
    at = (np.cumsum(lengths) - lengths)[rows][:, None] + np.arange(lo, hi)
    wide = np.where(np.arange(lo, hi) < lengths[rows][:, None], values[np.minimum(at, len(values) - 1)], 0.0)
    return wide if short else _whole(wide)


def partial_scores(left: pa.ChunkedArray, right: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Exact inner products of all rows of two list columns, some components at a time."""
    (a, na), (b, nb) = _flat(left, scale), _flat(right, scale)
    width = int(min(na.max(initial=0), nb.max(initial=0)))
    short = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width) < 2**53
    out = np.zeros((len(na), len(nb)), np.float64 if short else object)

    for lo in range(0, width, SLAB):
        hi, i, j = min(lo + SLAB, width), np.flatnonzero(na > lo), np.flatnonzero(nb > lo)
        out[np.ix_(i, j)] += _slab(a, na, i, lo, hi, short) @ _slab(b, nb, j, lo, hi, short).T
    return out


def _block(pick: Callable[[np.ndarray, np.ndarray], np.ndarray], scale: int) -> Callable[[pa.Table], pa.Table]:
    """Entries of one list: for some queries at a time, ``pick`` marks partial scores; a row's own is minus infinity there."""
    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        rid, name = table.column("rid").to_numpy(), table.column("_l")[0].as_py()
        q, c = np.flatnonzero(query), np.flatnonzero(~query)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(c):
            scores = partial_scores(table.column("part").take(pa.array(q)), table.column("part").take(pa.array(c)), scale)
            need = np.array([float("-inf") if x is None else x for x in table.column("need").take(pa.array(q)).to_pylist()], scores.dtype)
            for lo in range(0, len(q), LOOK):
                own = rid[q[lo: lo + LOOK]][:, None] == rid[c]
                some = np.where(own, float("-inf"), scores[lo: lo + LOOK])
                i, j = np.nonzero(pick(some, need[lo: lo + LOOK]) & ~own)
                found.append((rid[q[lo + i]], rid[c[j]], some[i, j].astype(np.float64)))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [[], [], []]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                     pa.array([name] * len(columns[0]), pa.int32()), pa.array(columns[2], pa.float64())], schema=_PARTIAL)

    return run


def _highest(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def pick(scores: np.ndarray, need: np.ndarray) -> np.ndarray:
        out = np.zeros(scores.shape, bool)
        some = min(k, scores.shape[1])
        np.put_along_axis(out, np.argpartition(-scores.astype(np.float64), some - 1, axis=1)[:, :some], True, axis=1)
        return out

    return pick


def _at_least(scores: np.ndarray, need: np.ndarray) -> np.ndarray:
    return (scores >= need[:, None]).astype(bool)


def _resolved(k: int, scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Exact scores of the pairs of a block, whose vectors come once each; the ``k`` best of each query."""
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("c", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return schema.empty_table()
        rid = vectors.column("rid").to_numpy()
        query = vectors.column("query").to_numpy(zero_copy_only=False).astype(bool)
        values, lengths = _flat(vectors.column("embedding"), scale)

        def rows(name: str, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The rows of one side that pairs name, and which of them each pair names."""
            own, which = np.unique(pairs.column(name).to_numpy(), return_inverse=True)
            held = np.flatnonzero(side)[np.argsort(rid[side])]
            return held[np.searchsorted(rid[held], own)], which

        (q, i), (c, j) = rows("q", query), rows("c", ~query)
        most, width = np.abs(values).max(initial=0), int(min(lengths[q].max(initial=0), lengths[c].max(initial=0)))
        short = float(most) ** 2 * max(1, width) < 2**53
        total = np.zeros(len(i), np.float64 if short else object)
        for lo in range(0, width, SLAB):
            a, b = (_slab(values, lengths, x, lo, min(lo + SLAB, width), short) for x in (q, c))
            for at in range(0, len(i), PAIRS):
                total[at: at + PAIRS] += (a[i[at: at + PAIRS]] * b[j[at: at + PAIRS]]).sum(1)
        score = total.astype(np.int64) if short else np.array([max(-_LIMIT, min(_LIMIT, int(x))) for x in total], np.int64)
        names = vectors.column("vec_id")
        missing = names.is_null().to_numpy()[c][j]
        number = names.fill_null(0).to_numpy()[c][j]
        order = np.lexsort((number, missing, -score, i))
        start = np.flatnonzero(np.diff(i[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
        best = order[rank < k]
        return pa.Table.from_arrays([pa.array(rid[q][i[best]]), names.take(pa.array(q[i[best]])), pa.array(rid[c][j[best]]),
                                     names.take(pa.array(c[j[best]])), pa.array(score[best])], schema=schema)

    return run


def phases(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, lists: int = 2, block: int = 4096, gather: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, collected, last): scored pairs of phase 1, entries of the lists in phase 2, scored pairs of phase 3.

    Scored pairs are (q, query_id, c, vec_id, score), entries (q, c, list, partial); q and c name rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    staged = Staged(spark)
    finite = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.coalesce(finite, F.lit(False))).withColumn("rid", F.monotonically_increasing_id())
    rows, _ = staged.table(rows.select("rid", F.col("vec_id").cast("long"), "embedding", "query"))
    alike = W.partitionBy("_h", "_g").orderBy(F.asc_nulls_last("vec_id"), "rid")
    named = rows.select("rid", "vec_id", F.xxhash64("embedding").alias("_h"), F.xxhash64(F.lit(1), "embedding").alias("_g"))
    able = named.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1).select("rid")
    held, _ = staged.table(rows.join(able, "rid", "left_semi").select("rid", "vec_id", "embedding"))
    asked, n, n_queries = rows.where("query").drop("query"), held.count(), rows.where("query").count()
    of_candidates, of_queries = max(1, -(-n // block)), max(1, -(-n_queries // block))

    def dealt(queries: DataFrame) -> DataFrame:
        """Both sides, one list at a time, under the keys of all blocks they are in; queries have what they ``need``."""
        def side(df, own, parts, other, others, query):
            part = F.expr(f"transform(array_sort(array_distinct(sequence(_l, greatest(_l, size(embedding) - 1), {lists}))), i -> get(embedding, i))")
            part = F.filter(part, lambda x: x.isNotNull())  # a list beyond the end of a short vector
            return (df.withColumns({own: F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"), "_l": F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))})
                    .withColumn("part", part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
                    .select("rid", "_q", "_c", "_l", "part", "need", F.lit(query).alias("query")))
        left = side(queries, "_q", of_queries, "_c", of_candidates, True)
        return left.unionByName(side(held.withColumn("need", F.lit(None).cast("long")), "_c", of_candidates, "_q", of_queries, False))

    def scored(pairs: DataFrame) -> DataFrame:
        """The ``k`` best of each query and block: pairs travel as two numbers, vectors once a block."""
        mine, other = F.pmod(F.xxhash64("q"), F.lit(of_queries)).cast("int"), F.pmod(F.xxhash64("c"), F.lit(of_candidates)).cast("int")
        keys = ["_q", "_c"]
        named = pairs.select(mine.alias("_q"), other.alias("_c"), "q", "c")
        own, others = F.pmod(F.xxhash64("rid"), F.lit(of_queries)).cast("int"), F.pmod(F.xxhash64("rid"), F.lit(of_candidates)).cast("int")
        columns = [*keys, "rid", "vec_id", "embedding", "query"]
        vectors = asked.withColumns({"_q": own, "_c": F.explode(F.sequence(F.lit(0), F.lit(of_candidates - 1))), "query": F.lit(True)}).select(columns).unionByName(
            held.withColumns({"_c": others, "_q": F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1))), "query": F.lit(False)}).select(columns))
        both = named.groupBy(*keys).cogroup(vectors.groupBy(*keys))
        return staged.table(both.applyInArrow(_resolved(k, scale), "q long, query_id long, c long, vec_id long, score long"))[0]

    highest = dealt(asked.withColumn("need", F.lit(None).cast("long"))).groupBy("_q", "_c", "_l").applyInArrow(_block(_highest(gather * k), scale), _PARTIALS)
    of_list = F.row_number().over(W.partitionBy("q", "list").orderBy(F.desc("partial")))
    first = scored(highest.withColumn("_r", of_list).where(F.col("_r") <= gather * k).select("q", "c").distinct())
    kth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    # Fewer than k scored pairs are all that there are, and need no second phase.
    cuts = first.withColumn("_r", kth).where(F.col("_r") == k).select("q", F.col("score").alias("cut"))
    cuts = F.broadcast(cuts) if n_queries <= BROADCAST else cuts
    need = F.when(F.col("cut") > -_LIMIT, F.expr(f"(cut div {lists}) + IF(cut > 0 AND cut % {lists} != 0, 1L, 0L)"))
    again = asked.join(cuts.withColumnRenamed("q", "rid"), "rid").withColumn("need", need).drop("cut")
    collected, _ = staged.table(dealt(again).groupBy("_q", "_c", "_l").applyInArrow(_block(_at_least, scale), _PARTIALS))
    seen = collected.groupBy("q", "c").agg(F.sum("partial").alias("sum"), F.sum(F.abs("partial")).alias("size"), F.count(F.lit(1)).alias("n")).join(cuts, "q")
    slack = 1 + 1e-9 * (F.col("size") + F.abs(F.col("cut")))
    left = seen.where(F.col("sum") + (lists - F.col("n")) * F.col("cut") / lists + slack >= F.col("cut"))
    return first, collected, scored(left.join(first, ["q", "c"], "left_anti"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, lists: int = 2, block: int = 4096, gather: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for each row for which ``is_query`` holds.

    Reads ``vec_id`` and ``embedding``.  Queries meet candidates in blocks of about ``block`` rows of each.
    """
    first, _, last = phases(vectors, is_query, k, scale, lists, block, gather)
    best = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return first.unionByName(last).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
