"""Repeated prompts and prompt intents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.content import is_codex_submitted
from logloom.functions.intents import group_key, with_intent
from logloom.functions.project import ProjectAlias
from logloom.functions.text import NOT_WS, compact, normalize_text, repeated_id
from logloom.operators.context import SESSION, attach_project
from logloom.operators.memo import EXAMPLE, grouped
from logloom.operators.scans import first_rows
from logloom.schema import Corpus
from logloom.session import stage_table

POSITION = ["file_path", "line", "seq"]


def codex_prompts(messages: DataFrame) -> DataFrame:
    return messages.filter(is_codex_submitted())


def _said(messages: DataFrame) -> DataFrame:
    """Grouped codex prompts that are not empty; blank texts go before the rules run, as a filter on what the rules give would run them twice."""
    prompts = codex_prompts(messages)
    if "group_key" in prompts.columns:
        return prompts.filter(F.col("literal") != "")
    return grouped(prompts.filter(F.col("content").rlike(NOT_WS)))


def _said_once(messages: DataFrame) -> DataFrame:
    """The same, written once without the texts where the rules have to run: for results that read them more than once."""
    if "group_key" in messages.columns:
        return _said(messages)
    return stage_table(_said(messages).drop("content", "group_key")).withColumn("group_key", group_key())


def _with_intent(prompts: DataFrame) -> DataFrame:
    return prompts if "intent_key" in prompts.columns else with_intent(prompts)


def _span(df: DataFrame, keys: list[str], extra: list) -> DataFrame:
    """Per key: count, sessions, first and last seen.  Sessions are folded first, so hot keys stay small."""
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    per_session = df.groupBy(*keys, *SESSION).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("f"), F.max(ts).alias("l"), *extra)
    return per_session


def repeated_groups(messages: DataFrame) -> DataFrame:
    """Every prompt group that occurs more than once (codex prompts): sample, category, counts and span."""
    prompts = _said(messages)
    sample = F.min_by("group_sample", F.struct(*POSITION))
    per = _span(prompts, ["group_key"], [F.min(F.struct(*POSITION)).alias("at"), sample.alias("sample"),
                                         F.first("category").alias("category")])
    groups = per.groupBy("group_key").agg(
        F.min_by("sample", "at").alias("sample"), F.first("category").alias("category"), F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("session_count"), F.min("f").alias("first_seen"), F.max("l").alias("last_seen"))
    return groups.filter(F.col("count") > 1).select(repeated_id(F.col("group_key")).alias("id"), "*")


def repeated_prompts(messages: DataFrame, limit: int = 10) -> DataFrame:
    """The most repeated prompt groups, newest first among equals."""
    return repeated_groups(messages).orderBy(
        F.desc("count"), F.desc_nulls_last("last_seen"), F.collate("sample", "UNICODE"), "id").limit(limit)


def repeated_variants(messages: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Spellings of the repeated prompts, one row each: a category may have any number of them.

    ``groups`` restricts the result, for example to :func:`repeated_prompts`.
    """
    prompts = _said_once(messages)
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    variants = prompts.groupBy("group_key", "literal").agg(
        F.min_by("variant_sample", F.struct(*POSITION)).alias("sample"), F.count(F.lit(1)).alias("count"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    groups = repeated_groups(prompts) if groups is None else groups
    return variants.join(groups.select("group_key", "id"), "group_key").select(
        "id", "group_key", "sample", "count", "first_seen", "last_seen")


def repeated_projects(corpus: Corpus, aliases: Sequence[ProjectAlias] = ()) -> DataFrame:
    """(id, group_key, project) of every repeated prompt."""
    prompts = _said_once(corpus.messages)
    pairs = prompts.select("group_key", *SESSION, "provider").distinct()
    named = attach_project(pairs, corpus, aliases).select("group_key", "project").distinct()
    return named.join(repeated_groups(prompts).select("group_key", "id"), "group_key").select(
        "id", "group_key", "project")


def intent_summary(corpus: Corpus, aliases: Sequence[ProjectAlias] = ()) -> DataFrame:
    """Per intent: prompts, share of all prompts, sessions, projects, three examples and span."""
    prompts = _with_intent(codex_prompts(corpus.messages))
    if "example" not in prompts.columns:
        prompts = prompts.withColumn("example", compact(F.col("content"), EXAMPLE))
    per = _span(prompts, ["intent_key", "intent_label"], [])
    named = attach_project(per.withColumn("provider", F.lit("codex")), corpus, aliases)
    projects = named.groupBy("intent_key", "project").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"), F.min("f").alias("f"), F.max("l").alias("l"),
        F.first("intent_label").alias("label"))
    buckets = projects.groupBy("intent_key").agg(
        F.first("label").alias("label"), F.sum("n").alias("count"), F.sum("s").alias("session_count"),
        F.count(F.lit(1)).alias("project_count"), F.min("f").alias("first_seen"), F.max("l").alias("last_seen"))
    samples = prompts.filter(F.col("example") != "").groupBy(
        "intent_key", normalize_text(F.col("example")).alias("same")).agg(
        F.min(F.struct(*POSITION)).alias("at"), F.min_by("example", F.struct(*POSITION)).alias("example"))
    samples = first_rows(samples, ["intent_key"], [F.col("at")], 3).groupBy("intent_key").agg(
        F.array_sort(F.collect_list(F.struct("at", "example"))).alias("e"))
    out = with_share(buckets.join(samples, "intent_key", "left"))
    return out.select("intent_key", "label", "count", "percentage", "session_count", "project_count",
                      F.coalesce(F.col("e.example"), F.array().cast("array<string>")).alias("examples"),
                      "first_seen", "last_seen")


def with_share(buckets: DataFrame) -> DataFrame:
    """Percentage with one decimal over at most one row per category."""
    total = buckets.agg(F.sum("count").alias("total")).scalar()
    return buckets.withColumn("percentage", F.floor(F.col("count") / total * 1000 + 0.5) / 10)


def intent_projects(corpus: Corpus, aliases: Sequence[ProjectAlias] = ()) -> DataFrame:
    """(intent_key, project) of every codex prompt."""
    pairs = _with_intent(codex_prompts(corpus.messages)).select("intent_key", *SESSION, "provider").distinct()
    return attach_project(pairs, corpus, aliases).select("intent_key", "project").distinct()


def intent_totals(buckets: DataFrame) -> DataFrame:
    """Total, classified and unclassified prompts; only the empty prompt is unclassified."""
    other = F.coalesce(F.sum(F.when(F.col("intent_key") == "other", F.col("count"))), F.lit(0))
    total = F.coalesce(F.sum("count"), F.lit(0))
    return buckets.agg(total.alias("total_messages"), (total - other).alias("classified_messages"),
                       other.alias("unclassified_messages"))


def intent_summary_visible(buckets: DataFrame, hidden_labels: Sequence[str]) -> DataFrame:
    """Summary without the hidden labels; shares refer to what is left."""
    cols = buckets.columns
    kept = buckets.filter(~F.col("label").isin(*hidden_labels)) if hidden_labels else buckets
    return with_share(kept.drop("percentage")).select(*cols)


def top_intents(buckets: DataFrame, n: int = 7) -> DataFrame:
    return buckets.filter(F.col("count") > 0).orderBy(
        F.desc("count"), F.desc_nulls_last("last_seen"), F.collate("label", "UNICODE")).limit(n)


def repeated_category_counts(groups: DataFrame) -> DataFrame:
    """Repeated groups per operational category."""
    return groups.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
