"""Ordered logic over files and sessions that stays parallel inside one huge group.

Each group is cut into chunks along its order.  A chunk is summarised with an ordinary aggregate, the few
summaries per group are scanned with a window, and the result is joined back on (group, chunk), where the
remaining work is a window inside one chunk.  No task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import stage_table

CHUNK_LINES = 16384


def line_chunk(line: str = "line") -> Column:
    """Chunk number of a line; it grows with the line, so chunks keep the order."""
    return F.floor(F.coalesce(F.col(line), F.lit(0)) / CHUNK_LINES)


def _join_offsets(df: DataFrame, offsets: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which null group keys meet."""
    right = offsets.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in offsets.columns if c not in on])
    test = F.col(on[0]).eqNullSafe(F.col(f"_r_{on[0]}"))
    for c in on[1:]:
        test = test & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return df.join(right, test, "left").drop(*[f"_r_{c}" for c in on])


def carry_forward(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
                  chunk: Column | None = None, before: DataFrame | None = None) -> DataFrame:
    """For every name in ``values``: the latest non-null value at or before the row, in ``order`` within ``keys``.

    Keys are never null.  The join and the window share one partitioning, so the rows are shuffled once.  ``before`` (keys and
    a column per name, one row per key) is what an earlier scan of the group ended with: it is the summary of a chunk before all others.
    """
    base = df.withColumn("_chunk", line_chunk(order[0]) if chunk is None else chunk)
    base = base.withColumns({f"_v_{n}": F.when(v.isNotNull(), F.struct(v.alias("x"))) for n, v in values.items()})
    on = keys + ["_chunk"]
    ends = base.groupBy(*on).agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in values
    ])
    if before is not None:
        first = F.lit(-1).cast(ends.schema["_chunk"].dataType).alias("_chunk")
        ends = ends.unionByName(before.select(*keys, first, *[F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("x"))).alias(f"_e_{n}") for n in values]))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    prefix = ends.select(*on, *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_p_{n}") for n in values])
    within = W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = base.join(prefix, on, "left")
    return out.withColumns({
        n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(within), F.col(f"_p_{n}"))["x"] for n in values
    }).drop("_chunk", *[f"_v_{n}" for n in values], *[f"_p_{n}" for n in values])


def running_sum(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
                chunk: Column | None = None) -> DataFrame:
    """Inclusive running sums in ``order`` within ``keys``."""
    base = df.withColumn("_chunk", line_chunk(order[0]) if chunk is None else chunk)
    base = base.withColumns({f"_v_{n}": v.cast("bigint") for n, v in values.items()})
    on = keys + ["_chunk"]
    sums = base.groupBy(*on).agg(*[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    prefix = sums.select(*on, *[F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in values])
    within = W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = base.join(prefix, on, "left")
    return out.withColumns({
        n: F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) + F.col(f"_p_{n}") for n in values
    }).drop("_chunk", *[f"_v_{n}" for n in values], *[f"_p_{n}" for n in values])


def ranked(df: DataFrame, groups: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """1-based position of each row inside its group under a total ``order``, for groups of any size.

    The rows are range-sorted by (group, order) and staged with their position; ranks follow from one offset per
    (group, partition).  Staging fixes the range bounds, so both uses of the sorted rows agree.
    """
    keys = [F.col(g) for g in groups] + order
    laid = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    laid = stage_table(laid)
    on = groups + ["_pid"]
    spans = laid.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    before = W.partitionBy(*groups).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = spans.select(*on, "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = _join_offsets(laid, offsets, on)
    return placed.withColumn(out, F.col("_off") + F.col("_pos") - F.col("_start") + 1).drop(
        "_pid", "_pos", "_start", "_off")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key; the limit runs before the shuffle, so hot keys send ``n`` rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
