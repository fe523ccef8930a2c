"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  ``timeZone`` decides day and hour keys, so a caller may pass
# another zone; duplicate JSON keys keep the last value.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession, time_zone: str = "UTC") -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", time_zone)
    return spark


def staging_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session, or one in its warehouse where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/staged").rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster has it installed)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove a staged table when its JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def stage_table(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage, survives executor loss).

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
