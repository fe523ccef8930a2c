"""The fingerprint of a cached corpus, kept up to date with the files that changed.

The fingerprint adds up one hash per logical file, so it is a multiset hash: a file's old share can be taken away and its new one added.  Shares are kept
per state of a log file (path, size, time, parser version) in ``prints/`` beside the cache.  An update reads the records of the states that have none yet and adds
their shares as one more load; what older states gave stays in its files and no longer counts, because sums are taken over the manifest of a snapshot.
Compaction changes no state, so it costs nothing here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.sessions import LIMBS, combined_prints, file_prints
from logloom.operators.snapshots import Snapshot, manifest, read_snapshot, snapshot
from logloom.session import stage_table

STATE = ["file_path", "size", "modified", "parser_version"]
PRINTS_DDL = f"file_path string, size bigint, modified timestamp, parser_version string, files bigint, {', '.join(f'{x} bigint' for x in LIMBS)}"


def _stored(spark: SparkSession, cache: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/prints")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], PRINTS_DDL)
    return spark.read.schema(PRINTS_DDL).parquet(f"{cache}/prints").dropDuplicates(STATE)


def update_prints(spark: SparkSession, cache: str, at: Snapshot | None = None) -> int:
    """Add the shares of every file state of a snapshot that has none; returns their number.  Repeating it changes nothing."""
    at = at or snapshot(spark, cache)
    listed = manifest(spark, cache, at).select(*STATE)
    pending = stage_table(listed.join(_stored(spark, cache).select(*STATE), STATE, "left_anti"))
    n = pending.count()
    if n:
        mine = pending.select("file_path")
        corpus = read_snapshot(spark, cache, at.version).map(lambda _, df: df.join(mine, "file_path", "left_semi"))
        shares = file_prints(corpus).groupBy("file_path").agg(F.count(F.lit(1)).alias("files"), *[F.sum(x).alias(x) for x in LIMBS])
        zero = F.lit(0).cast("bigint")
        rows = pending.join(shares, "file_path", "left").select(*STATE, *[F.coalesce(c, zero).alias(c) for c in ["files", *LIMBS]])
        rows.write.mode("overwrite").parquet(f"{cache}/prints/load={at.version}")
    return n


def cache_fingerprint(spark: SparkSession, cache: str, at: Snapshot | None = None) -> DataFrame:
    """One row: ``files`` and ``fingerprint`` as :func:`logloom.operators.sessions.corpus_fingerprint` gives them for the snapshot, from the kept shares, and ``state``, which
    also tells files apart that were replaced by others with the same counts.
    """
    at = at or snapshot(spark, cache)
    update_prints(spark, cache, at)
    listed = manifest(spark, cache, at).select(*STATE)
    digest = F.sha2(F.concat_ws("\0", "file_path", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("size", "parser_version")],
                                F.unix_micros("modified").cast("string")).cast("binary"), 256)
    shares = listed.withColumn("_d", digest).join(_stored(spark, cache), STATE)
    zero = F.lit(0).cast("bigint")
    limbs = [F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("bigint")) for i in range(8)]
    sums = shares.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ["files", *LIMBS]],
                      F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.coalesce(x, zero).cast("string") for x in limbs]).cast("binary"), 256).alias("state"))
    return combined_prints(sums)
