"""Connected components of a link table, as joins and aggregates only.

Alternating star contraction: a large-star step hangs every larger neighbour of a node under the smallest one, a small-star
step does so with the smaller neighbours.  Both are a minimum per node (folded before its shuffle) joined back to the links, so
a node with a third of all links is split by the skew join and never gathered.  Every round is a written table; the driver
sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Staged


def _lowest(links: DataFrame) -> DataFrame:
    """(node, low): the smallest of a node and what it links to."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u and v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger node to the smaller one."""
    low = _lowest(links)
    hung = links.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.unionByName(low.where("u > low").select("u", F.col("low").alias("v")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str, staged: Staged) -> DataFrame:
    """(node, component) for every node that has a link to another one; component is the smallest node reachable.

    ``a`` and ``b`` are long columns.  Repeated links, both directions, self links and null ends are allowed; the last two are
    ignored.  No links give an empty table.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u > v")
    now, path = staged.table(pairs.distinct())
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        if not mark[0]:
            break
        now, new = staged.table(_small_star(_large_star(now).distinct()).distinct())
        staged.drop(path)
        path = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
