"""Sessions by day, activity, projects and session spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.content import is_automation_message, is_submitted
from logloom.functions.project import ProjectAlias
from logloom.functions.times import day_key, in_range
from logloom.operators.context import SESSION, session_contexts
from logloom.operators.scans import first_rows
from logloom.operators.scope import Scope, visible_files
from logloom.operators.tokens import dedupe_token_events
from logloom.schema import Corpus, record_provider


def session_days(corpus: Corpus, scope: Scope = Scope()) -> DataFrame:
    """One row per session and local day with at least one submitted prompt.

    Only records of a file's own session count.  ``models`` lists the day's distinct models in turn order.
    """
    files = visible_files(corpus, scope)
    own = files.select(*SESSION).distinct()
    zero, none = F.lit(0).cast("bigint"), F.lit(None)
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    day = day_key(F.col("timestamp")).alias("day")

    def ranged(df: DataFrame) -> DataFrame:
        df = df.filter(in_range(F.col("timestamp"), scope.since, scope.until)) if scope.has_dates else df
        return df.join(own, SESSION, "left_semi")

    messages = ranged(corpus.messages).select(
        *SESSION, day, ts.alias("ts"), is_submitted().cast("bigint").alias("p"),
        is_automation_message().cast("bigint").alias("a"), (F.col("role") == "assistant").cast("bigint").alias("r"),
        zero.alias("t"))
    tokens = dedupe_token_events(ranged(corpus.token_usage), ["session_id"]).select(
        *SESSION, day, ts.alias("ts"), zero.alias("p"), zero.alias("a"), zero.alias("r"),
        F.col("usage.total_tokens").alias("t"))
    turns = ranged(corpus.turns)
    turn_rows = turns.select(*SESSION, day, ts.alias("ts"), zero.alias("p"), zero.alias("a"), zero.alias("r"),
                             zero.alias("t"))
    contexts = session_contexts(corpus, scope.aliases)
    starts = contexts.filter(F.col("session_timestamp") != "").withColumnRenamed("session_timestamp", "timestamp")
    if scope.has_dates:
        starts = starts.filter(in_range(F.col("timestamp"), scope.since, scope.until))
    # A session start only widens a day that has prompts: days of its own have none and drop below.
    start_rows = starts.select(*SESSION, day, ts.alias("ts"), zero.alias("p"), zero.alias("a"), zero.alias("r"),
                               zero.alias("t"))
    acts = messages.unionByName(tokens).unionByName(turn_rows).unionByName(start_rows)
    slices = acts.groupBy(*SESSION, "day").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.sum("p").alias("user_messages"),
        F.sum("a").alias("automation_messages"), F.sum("r").alias("assistant_messages"),
        F.sum("t").alias("total_tokens")).filter(F.col("user_messages") > 0)
    # Distinct first, so an array holds each model of a day once.
    models = turns.filter(F.col("model") != "").groupBy(*SESSION, day, "model").agg(F.min("line").alias("line"))
    models = models.groupBy(*SESSION, "day").agg(F.array_sort(F.collect_list(F.struct("line", "model"))).alias("m"))
    models = models.select(*SESSION, "day", F.col("m.model").alias("models"))
    out = slices.join(models, [*SESSION, "day"], "left").join(contexts, SESSION, "left")
    out = out.join(files.select(*SESSION, "provider", "source_label", F.col("title").alias("file_title"),
                                F.col("provider_conversation_id").alias("file_conversation_id")), SESSION)
    return out.select(
        record_provider().alias("provider"), "source_label", F.coalesce("file_title", "session_title").alias("title"),
        F.coalesce("file_conversation_id", "session_conversation_id").alias("provider_conversation_id"),
        *SESSION, F.col("day").alias("date_key"), "project", "cwd", "first_seen", "last_seen", "user_messages",
        "automation_messages", "assistant_messages", "total_tokens",
        F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def newest_sessions(days: DataFrame) -> DataFrame:
    return days.orderBy(F.desc("date_key"), F.desc_nulls_last("last_seen"), "session_id")


def activity_range(days: DataFrame) -> DataFrame:
    return days.agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def _file_key(df: DataFrame):
    """Identity of a logical file: the path, and the chat inside a key/value store."""
    return F.when(F.col("input_kind") == "cursor-vscdb", F.concat_ws("#", "file_path", "session_id")).otherwise(
        F.col("file_path"))


def list_projects(corpus: Corpus, aliases: Sequence[ProjectAlias] = ()) -> DataFrame:
    """Every project with its providers, directories, sessions, turns, prompts, tokens and activity.

    Tokens are summed without de-duplication and without a date range.
    """
    zero = F.lit(0).cast("bigint")
    ts = F.nullif(F.col("timestamp"), F.lit(""))

    def rows(df: DataFrame, turns=zero, prompts=zero, tokens=zero, day=F.lit(None).cast("string")) -> DataFrame:
        return df.select(_file_key(df).alias("file_key"), ts.alias("ts"), turns.cast("bigint").alias("n_turns"),
                         prompts.cast("bigint").alias("n_prompts"), tokens.alias("n_tokens"), day.alias("day"))

    m, one = corpus.messages, F.lit(1)
    acts = (rows(corpus.sessions)
            .unionByName(rows(corpus.turns, turns=one))
            .unionByName(rows(m, prompts=is_submitted(), day=F.when(is_submitted(), day_key(F.col("timestamp")))))
            .unionByName(rows(corpus.token_usage, tokens=F.col("usage.total_tokens"))))
    per_day = acts.groupBy("file_key", "day").agg(
        F.min("ts").alias("f"), F.max("ts").alias("l"), F.sum("n_turns").alias("n_turns"),
        F.sum("n_prompts").alias("n_prompts"), F.sum("n_tokens").alias("n_tokens"))
    per_file = per_day.groupBy("file_key").agg(
        F.min("f").alias("f"), F.max("l").alias("l"), F.sum("n_turns").alias("n_turns"),
        F.sum("n_prompts").alias("n_prompts"), F.sum("n_tokens").alias("n_tokens"),
        F.count("day").alias("n_sessions"))
    files = corpus.files.withColumn("file_key", _file_key(corpus.files)).join(
        session_contexts(corpus, aliases).select(*SESSION, "project", "cwd"), SESSION)
    return folded_projects(files, per_file)


def folded_projects(files: DataFrame, per_file: DataFrame) -> DataFrame:
    """Projects of files (with ``file_key``, project and directory) and their sums."""
    files = files.join(per_file, "file_key", "left")
    totals = files.groupBy("project").agg(
        F.coalesce(F.sum("n_sessions"), F.lit(0)).alias("sessions"),
        F.coalesce(F.sum("n_turns"), F.lit(0)).alias("turns"),
        F.coalesce(F.sum("n_prompts"), F.lit(0)).alias("messages"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"),
        F.min("f").alias("first_seen"), F.max("l").alias("last_seen"))
    providers = files.select("project", record_provider().alias("provider")).distinct().groupBy("project").agg(
        F.array_sort(F.collect_list("provider")).alias("providers"))
    samples = files.filter(F.col("cwd") != "").groupBy("project", "cwd").agg(
        F.min(F.struct("file_path", "session_id")).alias("at"))
    samples = first_rows(samples, ["project"], [F.col("at"), F.col("cwd")], 5).groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("at", "cwd"))).alias("c"))
    return (totals.join(providers, "project").join(samples, "project", "left")
            .select("project", "providers",
                    F.coalesce(F.col("c.cwd"), F.array().cast("array<string>")).alias("cwd_samples"),
                    "sessions", "turns", "messages", "total_tokens", "first_seen", "last_seen"))


PROJECT_ORDERS = {
    "tokens": [F.desc, "total_tokens"], "most_messages": [F.desc, "messages"], "fewest_messages": [F.asc, "messages"],
    "latest": [F.desc_nulls_last, "last_seen"], "name": None,
}


def order_projects(projects: DataFrame, by: str = "tokens") -> DataFrame:
    """Sorted project list; names compare by language rules, not by code point."""
    name = F.collate("project", "UNICODE")
    rule = PROJECT_ORDERS[by]
    return projects.orderBy(*([rule[0](rule[1])] if rule else []), name)


def all_projects_total(projects: DataFrame) -> DataFrame:
    """The row above the list: sums over all projects and the latest activity."""
    return projects.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "messages", "total_tokens")],
                        F.max("last_seen").alias("last_seen"))


def session_spans(corpus: Corpus, aliases: Sequence[ProjectAlias] = ()) -> DataFrame:
    """One row per logical file: project, directory, time span and record counts."""
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def rows(df: DataFrame, start=None, end=None, tools=zero, unknown=zero, warned=zero) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select("file_path", _file_key(df).alias("file_key"),
                         (none if start is None else start).alias("f"), (none if end is None else end).alias("l"),
                         tools.alias("tool_events"), unknown.alias("unknown_events"), warned.alias("warnings"))

    acts = (rows(corpus.sessions, ts, ts).unionByName(rows(corpus.turns, ts, ts))
            .unionByName(rows(corpus.messages, ts, ts)).unionByName(rows(corpus.token_usage, None, ts))
            .unionByName(rows(corpus.tool_events, tools=one)).unionByName(rows(corpus.unknown_events, unknown=one)))
    per_file = acts.groupBy("file_key").agg(
        F.min("f").alias("first_seen"), F.max("l").alias("last_seen"), F.sum("tool_events").alias("tool_events"),
        F.sum("unknown_events").alias("unknown_events"))
    warned = corpus.warnings.groupBy("file_path").agg(F.count(one).alias("warnings"))
    # A store's warnings belong to its first chat only.
    first = corpus.files.groupBy("file_path").agg(F.min("session_id").alias("first_session"))
    files = corpus.files.withColumn("file_key", _file_key(corpus.files)).join(
        session_contexts(corpus, aliases).select(*SESSION, "project", "cwd"), SESSION)
    out = files.join(per_file, "file_key", "left").join(first, "file_path").join(warned, "file_path", "left")
    return out.select(
        F.concat_ws("#", *SESSION).alias("id"), *SESSION, "project", "cwd", "first_seen", "last_seen", "line_count",
        F.coalesce("tool_events", zero).alias("tool_events"), F.coalesce("unknown_events", zero).alias("unknown_events"),
        F.when(F.col("session_id") == F.col("first_session"), F.coalesce("warnings", zero)).otherwise(zero)
        .alias("warnings"))


LIMBS = [f"s{i}" for i in range(8)]


def file_prints(corpus: Corpus) -> DataFrame:
    """One row per logical file: its path, and a hash of its counts and latest message as eight numbers that can be added up."""
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def rows(df: DataFrame, m=zero, t=zero, u=zero, last=None) -> DataFrame:
        return df.select(_file_key(df).alias("file_key"), m.alias("m"), t.alias("t"), u.alias("u"),
                         (F.lit(None).cast("string") if last is None else last).alias("last"))

    acts = (rows(corpus.messages, m=one, last=ts).unionByName(rows(corpus.turns, t=one))
            .unionByName(rows(corpus.token_usage, u=one)))
    counts = acts.groupBy("file_key").agg(F.sum("m").alias("m"), F.sum("t").alias("t"), F.sum("u").alias("u"),
                                          F.max("last").alias("last"))
    files = corpus.files.withColumn("file_key", _file_key(corpus.files)).join(counts, "file_key", "left")
    text = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "file_path", "provider", "session_id", "line_count")],
        *[F.coalesce(c, zero).cast("string") for c in ("m", "t", "u")], F.coalesce("last", F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    limbs = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    return files.select("file_path", *[x.alias(name) for name, x in zip(LIMBS, limbs)])


def combined_prints(sums: DataFrame) -> DataFrame:
    """The eight totals of a row of sums (with ``files``, the number of logical files) put together as ``fingerprint``."""
    joined = F.concat_ws(":", *[F.col(c).cast("string") for c in ["files", *LIMBS]])
    return sums.withColumn("fingerprint", F.sha2(joined.cast("binary"), 256)).drop(*LIMBS)


def corpus_fingerprint(corpus: Corpus) -> DataFrame:
    """One hash over every file's counts and latest message; equal corpora give equal hashes.

    Each file is hashed on its own and the hashes are summed, so no task ever holds the whole list.
    """
    zero = F.lit(0).cast("bigint")
    return combined_prints(file_prints(corpus).agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(x), zero).alias(x) for x in LIMBS]))
