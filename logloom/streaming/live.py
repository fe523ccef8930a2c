"""Keeping tables current: refresh on file arrival, and live token buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.usage import sum_usage
from logloom.operators.refresh import refresh_corpus
from logloom.schema import USAGE_FIELDS
from logloom.sources.ranges import SCHEMES
from logloom.streaming.growth import growing_lines


def refresh_stream(spark: SparkSession, root: str, cache_dir: str, checkpoint: str,
                   provider: str | None = None) -> StreamingQuery:
    """Refresh the cached tables whenever log files below ``root`` appear, grow, change or go.

    The stream only listens: a batch never reads the lines it stands for.  The refresh parses what was added and keeps its own account of it, so a batch
    that is repeated after a failure adds nothing twice.  In stores that tasks cannot list, only new files are noticed.
    """
    if "://" in root and root.split("://", 1)[0] not in SCHEMES:
        arrivals = (spark.readStream.format("text").option("recursiveFileLookup", "true")
                    .option("pathGlobFilter", "*.jsonl").load(root))
    else:
        arrivals = growing_lines(spark, [root], f"{checkpoint}/listings")

    def apply(batch: DataFrame, _: int) -> None:
        refresh_corpus(spark, cache_dir, [root], provider)

    return (arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _once(tokens: DataFrame, time: str, delay: str) -> DataFrame:
    """Token events without repeats (same file, time, turn and counters) within the delay."""
    keys = {f"_k{i}": F.col(f"usage.{n}") for i, n in enumerate(
        ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"))}
    return tokens.withColumns(keys).withWatermark(time, delay).dropDuplicatesWithinWatermark(
        ["file_path", "timestamp", "turn_id", *keys])


def live_token_buckets(tokens: DataFrame, grain: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Token sums per local day or hour (of the session's zone) over a stream of token rows with an event time ``ts``.

    Buckets are windows over local time, so a bucket is final, can be written in append mode, and leaves the state once the
    watermark has passed its end.  Later rows drop; where clocks go back, the repeated hour counts as one hour late.  Rows without an
    instant belong to no window: see :func:`live_unknown_tokens`.
    """
    zone = tokens.sparkSession.conf.get("spark.sql.session.timeZone")
    local = tokens.filter("ts IS NOT NULL").withColumn("_local", F.from_utc_timestamp("ts", zone))
    sums = _once(local, "_local", delay).groupBy(F.window("_local", grain).alias("_w")).agg(*sum_usage())
    pattern = "yyyy-MM-dd" if grain.endswith("day") else "yyyy-MM-dd HH:00"
    return sums.select(F.date_format(F.to_utc_timestamp("_w.start", zone), pattern).alias("bucket"), *USAGE_FIELDS)


def live_unknown_tokens(tokens: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Token events without an instant, under the bucket ``unknown``, as a stream of its own: without a time nothing of it is ever final.

    ``arrived`` is when a row was read; repeats within the delay drop.
    """
    lost = tokens.filter("ts IS NULL").withColumn("arrived", F.current_timestamp())
    return _once(lost, "arrived", delay).select(F.lit("unknown").alias("bucket"), "arrived", "usage.*")
