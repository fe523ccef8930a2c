"""Log files as numbered lines with the detected provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.jsonv import parse_line, str_at, truthy
from logloom.functions.text import WS

# Record types of the second provider, and where its logs live.
CLAUDE_TYPES = ["assistant", "attachment", "queue-operation", "summary", "system", "title", "user"]
CLAUDE_PATH = "/.claude/projects/"


def plain_path(c: Column) -> Column:
    """Path without the scheme of local files."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"\Afile:/+", "/"))


def is_blank(c: Column) -> Column:
    return c.rlike(rf"\A{WS}*\z")


def looks_like_claude(path: Column, first_value: Column) -> Column:
    v = parse_line(first_value)
    known = str_at(v, "$.type").isin(*CLAUDE_TYPES)
    marked = truthy(v, "$.message") | truthy(v, "$.uuid") | truthy(v, "$.sessionId") | truthy(v, "$.session_id")
    return path.contains(CLAUDE_PATH) | F.coalesce(known & marked, F.lit(False))


def read_lines(spark: SparkSession, paths: list[str], options: dict[str, str] | None = None) -> DataFrame:
    """(file_path, chunk, line, value, provider) of every line, blank ones included.

    Lines are numbered per input split, and splits get the line count of the splits before them, so a file of
    any size is read in parallel.  The provider follows from the path or the file's first non-blank record.
    """
    raw = spark.read.options(**(options or {})).text(paths).select(
        "value", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"))
    on = ["uri", "chunk"]
    splits = raw.groupBy(*on).agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"),
        F.min_by("value", F.when(~is_blank(F.col("value")), F.col("pos"))).alias("first_value"))
    before = W.partitionBy("uri").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("uri").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = splits.select(
        *on, "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.first("first_value", ignorenulls=True).over(whole).alias("first_value"))
    placed = placed.select(
        *on, "start", "offset",
        F.when(looks_like_claude(F.col("uri"), F.col("first_value")), "claude").otherwise("codex").alias("provider"))
    return raw.join(placed, on).select(
        plain_path(F.col("uri")).alias("file_path"), "chunk",
        (F.col("offset") + F.col("pos") - F.col("start") + 1).alias("line"), "value", "provider")


def session_id_from_path(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"\Arollout-", ""), r"\.(jsonl|json|zip|data|vscdb|md)\z", "")
