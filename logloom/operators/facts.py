"""Mergeable daily facts: what summaries count, kept per file and updated with the files that changed.

Facts belong to one state of a log file (path, size, time).  An update computes them for the states that have none yet and adds them as one more
load; facts of older states stay in their files and no longer count, because reading joins them with the manifest of a snapshot.  Subtracting a
file's old facts and adding its new ones thus needs no rewriting, and compaction of the cache changes nothing here.

Sums are per (file, session, day, hour).  Distinct counts stay exact: prompt groups are kept as a table of digests, models as rows.  Day and hour
keys are local, so facts live below a folder named after the session's time zone, and prompt groups below one named after the version of the rules.
"""

from __future__ import annotations

import hashlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.content import is_automation_message, is_submitted
from logloom.functions.project import provider_project
from logloom.functions.times import bucket_key
from logloom.operators.context import SESSION, session_contexts
from logloom.operators.memo import annotated, prompt_memo, rule_version
from logloom.operators.scope import Scope, provider_in_scope
from logloom.operators.sessions import folded_projects
from logloom.operators.snapshots import Snapshot, manifest, read_snapshot, snapshot
from logloom.operators.tokens import dedupe_token_events
from logloom.schema import USAGE_FIELDS, Corpus, record_provider
from logloom.session import stage_table

STATE = ["file_path", "size", "modified"]
_STATE_DDL = "size bigint, modified timestamp"
COUNTS = ["prompts", "automation", "assistant", "turns", "tools", "unknown", "raw_tokens", "session_tokens", "token_events"]
DDL = {
    "states": f"file_path string, {_STATE_DDL}, warnings bigint",
    "activity": f"file_path string, session_id string, provider string, day string, hour string, {', '.join(f'{c} bigint' for c in COUNTS)}, "
                f"{', '.join(f'{c} bigint' for c in USAGE_FIELDS)}, first_seen string, last_seen string, first_start string, last_start string, {_STATE_DDL}",
    "groups": f"file_path string, session_id string, day string, hour string, digest string, {_STATE_DDL}",
    "models": f"file_path string, session_id string, day string, model string, line bigint, {_STATE_DDL}",
    "contexts": "file_path string, session_id string, cwd string, context_provider string, session_timestamp string, session_title string, session_conversation_id string, "
                f"{_STATE_DDL}",
}


def facts_dir(spark: SparkSession, cache: str) -> str:
    zone = spark.conf.get("spark.sql.session.timeZone")
    return f"{cache}/facts/{hashlib.sha256(zone.encode()).hexdigest()[:8]}-{rule_version()}"


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], DDL[name])
    return spark.read.schema(DDL[name]).parquet(f"{folder}/{name}")


def _activity(c: Corpus, said: DataFrame) -> DataFrame:
    """Sums per (file, session, provider, day, hour) of all records."""
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")

    def rows(df: DataFrame, seen: bool = True, **sums) -> DataFrame:
        values = {name: zero for name in [*COUNTS, *USAGE_FIELDS]} | sums
        return df.select(
            *SESSION, record_provider().alias("provider"), bucket_key(F.col("timestamp"), "day").alias("day"), bucket_key(F.col("timestamp"), "hour").alias("hour"),
            *[v.cast("bigint").alias(n) for n, v in values.items()], (ts if seen else none).alias("seen"), (none if seen else ts).alias("start"))

    one = F.lit(1)
    total = F.coalesce(F.col("usage.total_tokens"), zero)
    once, per_session = dedupe_token_events(c.token_usage), dedupe_token_events(c.token_usage, ["session_id"])
    parts = [
        rows(said, prompts=is_submitted().cast("int"), automation=is_automation_message().cast("int"), assistant=(F.col("role") == "assistant").cast("int")),
        rows(c.turns, turns=one), rows(c.token_usage, raw_tokens=total), rows(per_session, session_tokens=total),
        rows(once, token_events=one, **{f: F.coalesce(F.col(f"usage.{f}"), zero) for f in USAGE_FIELDS}),
        rows(c.sessions, seen=False), rows(c.tool_events, tools=one).withColumn("seen", none), rows(c.unknown_events, unknown=one).withColumn("seen", none)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*SESSION, "provider", "day", "hour").agg(
        *[F.sum(n).alias(n) for n in [*COUNTS, *USAGE_FIELDS]], F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
        F.min("start").alias("first_start"), F.max("start").alias("last_start"))


def computed(c: Corpus, memo: str | None = None) -> dict[str, DataFrame]:
    """Fact tables of a corpus, without the state of their files."""
    said = annotated(c.messages, prompt_memo(c.messages, memo))
    day, hour = bucket_key(F.col("timestamp"), "day").alias("day"), bucket_key(F.col("timestamp"), "hour").alias("hour")
    return {
        "activity": _activity(c, said),
        "groups": said.filter(is_submitted()).select(*SESSION, day, hour, F.sha2("group_key", 256).alias("digest")).distinct(),
        "models": c.turns.filter(F.col("model") != "").groupBy(*SESSION, day, "model").agg(F.min("line").alias("line")),
        "contexts": session_contexts(c, with_provider=True).select(*SESSION, "cwd", "context_provider", "session_timestamp", "session_title", "session_conversation_id"),
    }


def update_facts(spark: SparkSession, cache: str, memo: str | None = None, at: Snapshot | None = None) -> int:
    """Compute the facts of every file state of the latest snapshot that has none; returns their number.  ``states`` is written last, so facts of an
    interrupted update are not read, and a repeated one replaces them."""
    at = at or snapshot(spark, cache)
    folder = facts_dir(spark, cache)
    listed = manifest(spark, cache, at).select(*STATE)
    pending = stage_table(listed.join(_read(spark, folder, "states").select(*STATE), STATE, "left_anti"))
    n = pending.count()
    if n:
        mine = pending.select("file_path")
        corpus = read_snapshot(spark, cache, at.version).map(lambda _, df: df.join(mine, "file_path", "left_semi"))
        warned = corpus.warnings.groupBy("file_path").agg(F.count(F.lit(1)).alias("warnings"))
        for name, rows in computed(corpus, memo).items():
            rows.join(pending, "file_path").select(*_columns(name)).hint("rebalance").write.mode("overwrite").parquet(f"{folder}/{name}/load={at.version}")
        states = pending.join(warned, "file_path", "left").withColumn("warnings", F.coalesce("warnings", F.lit(0)))
        states.select(*_columns("states")).write.mode("overwrite").parquet(f"{folder}/states/load={at.version}")
    return n


def _columns(name: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in DDL[name].split(",")]


class Facts:
    """Fact tables of the files of a snapshot, restricted to a project and provider."""

    def __init__(self, spark: SparkSession, cache: str, scope: Scope = Scope(), at: Snapshot | None = None):
        if scope.has_dates:
            raise ValueError("facts are whole days; use the direct operators for a date range")
        self.at = at or snapshot(spark, cache)
        folder = facts_dir(spark, cache)
        states = manifest(spark, cache, self.at).select(*STATE)
        corpus = read_snapshot(spark, cache, self.at.version)
        contexts = _read(spark, folder, "contexts").join(states, STATE, "left_semi").drop("size", "modified")
        provider = F.coalesce("context_provider", F.lit("codex"))
        self.contexts = contexts.withColumn("project", provider_project(provider, F.col("cwd"), scope.aliases))
        self.every_file = corpus.files.join(self.contexts, SESSION, "left")
        files = self.every_file.filter(provider_in_scope(scope.provider))
        if scope.one_project:
            files = files.filter(F.col("project") == scope.one_project)
        self.files = files
        restrict = bool(scope.one_project or (scope.provider and scope.provider != "all"))

        def read(name: str) -> DataFrame:
            rows = _read(spark, folder, name).join(states, STATE, "left_semi").drop("size", "modified")
            return rows.join(files.select("file_path").distinct(), "file_path", "left_semi") if restrict else rows

        self.every_activity = _read(spark, folder, "activity").join(states, STATE, "left_semi").drop("size", "modified")
        self.activity, self.groups, self.models, self.states = (read(n) for n in ("activity", "groups", "models", "states"))
        if not restrict:  # warnings count for files of the corpus only
            self.states = self.states.join(files.select("file_path").distinct(), "file_path", "left_semi")

    def totals(self) -> DataFrame:
        """One row of counts, from the sums and the digests."""
        own = self.files.select(*SESSION).distinct()
        days = self.activity.groupBy(*SESSION, "day").agg(*[F.sum(c).alias(c) for c in ("prompts", "automation", "assistant", "turns", "tools", "unknown")])
        days = days.join(own.withColumn("own", F.lit(True)), SESSION, "left")
        zero = F.lit(0).cast("bigint")
        sums = days.agg(
            F.count_if(F.col("own") & (F.col("prompts") > 0)).alias("sessions"), *[F.coalesce(F.sum(c), zero).alias(n) for c, n in (
                ("turns", "turns"), ("prompts", "user_messages"), ("automation", "automation_messages"), ("assistant", "assistant_messages"))],
            *[F.coalesce(F.sum(c), zero).alias(n) for c, n in (("tools", "tool_events"), ("unknown", "unknown_events"))])
        unique = self.groups.agg(F.count_distinct("digest").alias("n")).scalar()
        warned = self.states.agg(F.coalesce(F.sum("warnings"), zero).alias("n")).scalar()
        return sums.select("sessions", "turns", "user_messages", "automation_messages", "assistant_messages", unique.alias("unique_user_messages"), "tool_events",
                           "unknown_events", warned.alias("parse_warnings"))

    def message_buckets(self, grain: str = "day") -> DataFrame:
        key = F.col(grain).alias("bucket")
        sums = self.activity.groupBy(key).agg(F.sum("prompts").alias("messages"), *[F.sum(f).alias(f) for f in USAGE_FIELDS], F.sum("token_events").alias("spent"))
        unique = self.groups.groupBy(key).agg(F.count_distinct("digest").alias("unique_messages"))
        out = sums.filter((F.col("messages") > 0) | (F.col("spent") > 0)).join(unique, "bucket", "left")
        return out.select("bucket", "messages", F.coalesce("unique_messages", F.lit(0)).alias("unique_messages"), *USAGE_FIELDS)

    def token_buckets(self, grain: str = "day") -> DataFrame:
        sums = self.activity.groupBy(F.col(grain).alias("bucket")).agg(*[F.sum(f).alias(f) for f in USAGE_FIELDS], F.sum("token_events").alias("spent"))
        return sums.filter("spent > 0").select("bucket", *USAGE_FIELDS)

    def provider_usage(self) -> DataFrame:
        days = self.activity.groupBy("provider", *SESSION, "day").agg(F.sum("prompts").alias("n"), F.sum("total_tokens").alias("t"), F.sum("token_events").alias("spent"))
        sums = days.groupBy("provider").agg(F.count_if(F.col("n") > 0).alias("sessions"), F.sum("n").alias("messages"), F.sum("t").alias("total_tokens"), F.sum("spent").alias("spent"))
        listed = self.files.select(record_provider().alias("provider")).distinct().withColumn("listed", F.lit(True))
        joined = listed.join(sums, "provider", "full_outer").filter(F.col("listed") | (F.col("messages") > 0) | (F.col("spent") > 0))
        return joined.select("provider", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "messages", "total_tokens")])

    def session_days(self) -> DataFrame:
        """As :func:`logloom.operators.sessions.session_days`."""
        files = self.files.withColumnsRenamed({"title": "file_title", "provider_conversation_id": "file_conversation_id"})
        days = self.activity.groupBy(*SESSION, "day").agg(
            F.min("first_seen").alias("f"), F.max("last_seen").alias("l"), F.sum("prompts").alias("user_messages"), F.sum("automation").alias("automation_messages"),
            F.sum("assistant").alias("assistant_messages"), F.sum("session_tokens").alias("total_tokens")).filter("user_messages > 0")
        models = self.models.groupBy(*SESSION, "day").agg(F.array_sort(F.collect_list(F.struct("line", "model")))["model"].alias("models"))
        start = F.when(F.col("session_timestamp") != "", F.struct(F.col("session_timestamp").alias("timestamp")))
        out = files.join(days, SESSION).join(models, [*SESSION, "day"], "left").withColumn("_start", start["timestamp"])
        mine = F.when(bucket_key(F.col("_start"), "day") == F.col("day"), F.col("_start"))  # a start widens its own day
        return out.select(
            record_provider().alias("provider"), "source_label", F.coalesce("file_title", "session_title").alias("title"),
            F.coalesce("file_conversation_id", "session_conversation_id").alias("provider_conversation_id"), *SESSION, F.col("day").alias("date_key"), "project", "cwd",
            F.least("f", mine).alias("first_seen"), F.greatest("l", mine).alias("last_seen"), "user_messages", "automation_messages", "assistant_messages", "total_tokens",
            F.coalesce("models", F.array().cast("array<string>")).alias("models"))

    def list_projects(self) -> DataFrame:
        """As :func:`logloom.operators.sessions.list_projects`: all files, whatever the scope."""
        key = F.when(F.col("input_kind") == "cursor-vscdb", F.concat_ws("#", *SESSION)).otherwise(F.col("file_path"))
        kinds = self.every_file.groupBy("file_path").agg(F.first("input_kind").alias("input_kind"))
        days = self.every_activity.join(kinds, "file_path").withColumn("file_key", key).groupBy("file_key", "day").agg(
            F.min(F.least("first_seen", "first_start")).alias("f"), F.max(F.greatest("last_seen", "last_start")).alias("l"), F.sum("turns").alias("n_turns"),
            F.sum("prompts").alias("n_prompts"), F.sum("raw_tokens").alias("n_tokens"))
        per_file = days.groupBy("file_key").agg(
            F.min("f").alias("f"), F.max("l").alias("l"), F.sum("n_turns").alias("n_turns"), F.sum("n_prompts").alias("n_prompts"), F.sum("n_tokens").alias("n_tokens"),
            F.count_if(F.col("n_prompts") > 0).alias("n_sessions"))
        return folded_projects(self.every_file.withColumn("file_key", key), per_file)
