"""Token usage: de-duplication, totals, buckets, models and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.content import is_submitted
from logloom.functions.times import bucket_key, day_key
from logloom.functions.usage import sum_usage
from logloom.operators.context import SESSION, attach_model
from logloom.operators.memo import grouped
from logloom.operators.scans import first_rows
from logloom.schema import USAGE_FIELDS, record_provider

# The fields that identify a repeated token event.
DEDUPE_USAGE = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def dedupe_token_events(tokens: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Keep the first of equal events of a file; the session is not part of the identity unless asked for."""
    named = {f"_k{i}": F.col(f"usage.{f}") for i, f in enumerate(DEDUPE_USAGE)}
    keys = ["file_path", "timestamp", "turn_id", *named, *(extra or [])]
    return first_rows(tokens.withColumns(named), keys, [F.col("line")]).drop(*named)


def token_totals(tokens: DataFrame) -> DataFrame:
    """One row with the eight sums over distinct events."""
    return dedupe_token_events(tokens).agg(*sum_usage())


def token_buckets(tokens: DataFrame, grain: str = "day") -> DataFrame:
    """Token sums per local day or hour."""
    return dedupe_token_events(tokens).groupBy(bucket_key(F.col("timestamp"), grain).alias("bucket")).agg(*sum_usage())


def message_buckets(messages: DataFrame, tokens: DataFrame, grain: str = "day") -> DataFrame:
    """Submitted prompts, distinct prompts and token sums per bucket; a bucket needs prompts or tokens."""
    prompts = grouped(messages.filter(is_submitted()).withColumn("bucket", bucket_key(F.col("timestamp"), grain)))
    counts = prompts.groupBy("bucket").agg(F.count(F.lit(1)).alias("messages"),
                                           F.count_distinct("group_key").alias("unique_messages"))
    joined = counts.join(token_buckets(tokens, grain), "bucket", "full_outer")
    return joined.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c)
                                     for c in ["messages", "unique_messages", *USAGE_FIELDS]])


def model_usage(turns: DataFrame, tokens: DataFrame) -> DataFrame:
    """Turns and distinct token sums per model; events of no known turn count as ``unknown``."""
    per_turn = turns.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("turns"))
    used = attach_model(dedupe_token_events(tokens), turns)
    per_token = used.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(*sum_usage())
    joined = per_turn.join(per_token, "model", "full_outer")
    return joined.select("model", *[F.coalesce(c, F.lit(0)).alias(c) for c in ["turns", *USAGE_FIELDS]])


def provider_usage(files: DataFrame, messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sessions (distinct file, session and day with a prompt), prompts and tokens per provider."""
    provider = record_provider().alias("provider")
    prompts = messages.filter(is_submitted()).groupBy(
        provider, *SESSION, day_key(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    talked = prompts.groupBy("provider").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("messages"))
    spent = dedupe_token_events(tokens).groupBy(provider).agg(F.sum("usage.total_tokens").alias("total_tokens"))
    listed = files.select(provider).distinct()
    joined = listed.join(talked, "provider", "full_outer").join(spent, "provider", "full_outer")
    return joined.select("provider", *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                       ["sessions", "messages", "total_tokens"]])


def hour_of_day(buckets: DataFrame, value: str = "messages") -> DataFrame:
    """Hour buckets folded to 24 hours, zero-filled; nothing when every hour is zero.

    ``buckets`` is a :func:`message_buckets` result by hour.
    """
    folded = buckets.filter(F.col("bucket") != "unknown").groupBy(
        F.substring("bucket", 12, 2).cast("int").alias("hour")).agg(F.sum(value).alias("n"))
    hours = buckets.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    some = folded.agg(F.coalesce(F.bool_or(F.col("n") > 0), F.lit(False)).alias("some")).scalar()
    return hours.join(folded, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("count")).filter(some)


def hour_of_day_tokens(buckets: DataFrame) -> DataFrame:
    """Input and output tokens per hour of the day; zeros are left out."""
    folded = buckets.filter(F.col("bucket") != "unknown").groupBy(
        F.substring("bucket", 12, 2).cast("int").alias("hour")).agg(
        F.sum("input_tokens").alias("Input"), F.sum("output_tokens").alias("Output"))
    return folded.unpivot(["hour"], ["Input", "Output"], "kind", "value").filter(F.col("value") > 0)


def weekday_messages(buckets: DataFrame) -> DataFrame:
    """Day buckets folded to weekdays, 1 is Sunday; nothing when every day is zero."""
    day = F.try_to_timestamp("bucket", F.lit("yyyy-MM-dd"))
    folded = buckets.withColumn("weekday", F.dayofweek(day)).filter(F.col("weekday").isNotNull()).groupBy(
        "weekday").agg(F.sum("messages").alias("n"))
    days = buckets.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
    some = folded.agg(F.coalesce(F.bool_or(F.col("n") > 0), F.lit(False)).alias("some")).scalar()
    return days.join(folded, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("count")).filter(some)


