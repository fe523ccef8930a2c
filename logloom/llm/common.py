"""What the operators share: staged tables, worker paths, bounded slices of Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import delete_at_exit

#: Characters or bytes of text that a task turns into numpy arrays at once.
SLICE = 1 << 20

#: Whether a query's shuffle files go when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster has it installed)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/staged").rstrip("/")


class Staged:
    """Tables written to the shared folder, each readable until ``drop`` is called for it or the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` and read it back: its lineage ends there, and a lost executor costs a re-read."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of a written table again
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        delete_at_exit(self.spark, self.root)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        """Delete a table that a later one has replaced."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator reads, under its own names; whatever else the table holds cannot clash."""
    return df.select(*[df[f"`{column}`"].alias(name) for name, column in names.items()])


def aside(df: DataFrame, *read: str) -> DataFrame:
    """``df`` with all columns but those that are read renamed to c0, c1, ...: no name of theirs meets one that an operator adds."""
    return df.toDF(*[name if name in read else f"c{i}" for i, name in enumerate(df.columns)])


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``size`` bytes of ``column`` (one row at least)."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def paired_blocks(rows: DataFrame, n: str, by: str, block: int) -> DataFrame:
    """Copies of ``rows`` by which every two rows of a group meet, in blocks of about ``block`` rows.

    ``n`` holds the size of the row's group, ``by`` what its rows differ in.  A group of up to ``block`` rows stays whole.  A larger one is
    dealt into parts; each pair of parts, and each part with itself, becomes a block of its own.  New columns: ``_part``, and ``_lo`` and ``_hi``, the
    two parts of the block (equal for a part with itself).
    """
    parts = F.ceil(F.col(n) / block).cast("int")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int"))
    met = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), parts - 1)))
    return met.withColumns({"_lo": F.least("_part", "_with"), "_hi": F.greatest("_part", "_with")}).drop("_with")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, with the starts of the groups and the end; only the last group is held back meanwhile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = _starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
            table = table.slice(starts[-1])
        held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_starts(table, keys), table.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
