"""Prompt-to-response interactions.

An interaction is a submitted prompt with the records up to the next prompt or automation.  Its records stay rows
(one interaction may hold any number of them); per-interaction facts are aggregates over those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.content import is_automation_message, is_submitted
from logloom.functions.intents import with_intent
from logloom.functions.intents import OPERATIONAL
from logloom.functions.text import display_text, js_trim
from logloom.functions.times import day_key
from logloom.operators.context import SESSION
from logloom.operators.scans import carry_forward, first_rows, running_sum
from logloom.schema import USAGE_TYPE, Corpus


def prompt_ordinals(messages: DataFrame, date_key: str | None = None) -> DataFrame:
    """Submitted prompts numbered within their session (optionally of one day)."""
    prompts = messages.filter(is_submitted())
    if date_key:
        prompts = prompts.filter(day_key(F.col("timestamp")) == date_key)
    return running_sum(prompts, SESSION, ["line", "seq"], {"prompt_no": F.lit(1)})


def interaction_events(corpus: Corpus) -> DataFrame:
    """Messages, tool events and token events in one shape; prompts and automations are boundaries."""
    none = F.lit(None).cast("string")
    no_usage = F.lit(None).cast(USAGE_TYPE)
    boundary = is_submitted() | is_automation_message()
    kind = (F.when(is_submitted(), "prompt").when(is_automation_message(), "automation")
            .when(F.col("role") == "assistant", "assistant").otherwise("context"))
    m = corpus.messages.select(
        *SESSION, "line", "seq", F.lit(0).alias("rank"), kind.alias("kind"), boundary.cast("int").alias("boundary"),
        "turn_id", "timestamp", "role", "source_event", "content",
        display_text(F.col("content"), F.col("source_event")).alias("display"), none.alias("name"),
        no_usage.alias("usage"))
    t = corpus.tool_events.select(
        *SESSION, "line", "seq", F.lit(1).alias("rank"), F.lit("tool").alias("kind"), F.lit(0).alias("boundary"),
        "turn_id", "timestamp", none.alias("role"), F.col("event_type").alias("source_event"), "content",
        none.alias("display"), "name", no_usage.alias("usage"))
    u = corpus.token_usage.select(
        *SESSION, "line", F.lit(0).alias("seq"), F.lit(2).alias("rank"), F.lit("tokens").alias("kind"),
        F.lit(0).alias("boundary"), "turn_id", "timestamp", none.alias("role"), none.alias("source_event"),
        none.alias("content"), none.alias("display"), none.alias("name"), "usage")
    return m.unionByName(t).unionByName(u)


def interaction_records(corpus: Corpus) -> DataFrame:
    """Every record that belongs to an interaction, with ``prompt_line`` of its prompt.

    Records share the interval strictly after the prompt's line and before the next boundary's line.  Assistant and
    context messages with a display text seen earlier in the same interaction are left out.
    """
    events = interaction_events(corpus)
    # Records on the boundary's own line belong to no interval: number the line after its boundary.
    at = F.col("boundary") == 1
    placed = carry_forward(events, SESSION, ["line", "rank", "seq"],
                           {"last_boundary": F.when(at, F.struct("line", "kind"))})
    inside = placed.filter((F.col("last_boundary.kind") == "prompt")
                           & ((F.col("line") > F.col("last_boundary.line")) | (F.col("kind") == "prompt")))
    inside = inside.withColumn("prompt_line", F.col("last_boundary.line")).drop("last_boundary", "boundary")
    said = inside.filter(F.col("kind").isin("assistant", "context"))
    said = first_rows(said, [*SESSION, "prompt_line", "kind", "display"], [F.col("line"), F.col("seq")])
    return said.unionByName(inside.filter(~F.col("kind").isin("assistant", "context")))


def interactions(corpus: Corpus) -> DataFrame:
    """One row per submitted prompt: response, context, tool and token counts, last response and headline tokens."""
    r = interaction_records(corpus)
    k = F.col("kind")
    order = F.struct("line", "seq")
    grouped = r.groupBy(*SESSION, "prompt_line").agg(
        F.min_by(F.struct("turn_id", "timestamp", "content"), F.when(k == "prompt", order)).alias("p"),
        F.count_if(k == "assistant").alias("assistant_messages"), F.count_if(k == "context").alias("context_messages"),
        F.count_if(k == "tool").alias("tool_events"), F.count_if(k == "tokens").alias("token_events"),
        F.max_by("content", F.when(k == "assistant", order)).alias("last_response"),
        F.max_by("usage", F.when(k == "tokens", order)).alias("usage"))
    grouped = grouped.filter(F.col("p").isNotNull()).withColumn("turn_id", F.col("p.turn_id"))
    timing = corpus.task_timings.groupBy(*SESSION, "turn_id").agg(
        F.min(F.struct("started_at", "completed_at", "duration_ms", "time_to_first_token_ms")).alias("timing"))
    out = grouped.join(timing, [*SESSION, "turn_id"], "left")
    return out.select(
        *SESSION, F.col("prompt_line").alias("line"), "turn_id", F.col("p.timestamp").alias("timestamp"),
        F.col("p.content").alias("prompt"), "assistant_messages", "context_messages", "tool_events", "token_events",
        "last_response", "usage", "timing.duration_ms", "timing.time_to_first_token_ms")


def hit_to_prompt(corpus: Corpus) -> DataFrame:
    """For every message the prompt it belongs to: the latest at or before it, else the session's first."""
    m = corpus.messages
    owned = carry_forward(m, SESSION, ["line", "seq"], {"before": F.when(is_submitted(), F.col("line"))})
    first = m.filter(is_submitted()).groupBy(*SESSION).agg(F.min("line").alias("first"))
    return owned.join(first, SESSION, "left").select(
        *SESSION, "line", "seq", "role", "source_event", F.coalesce("before", "first").alias("prompt_line"))


def turn_interactions(corpus: Corpus) -> DataFrame:
    """One row per codex prompt with facts of its turn: last response, first tokens, first timing, tools, context.

    Tool events and context messages of a turn stay rows of their tables, keyed by (file, turn); here they are counted.
    """
    none = F.lit("\0")  # prompts without a turn id share the records without one
    turn = F.coalesce("turn_id", none).alias("turn_key")
    m = corpus.messages.withColumn("turn_key", F.coalesce("turn_id", none))
    reply = ~F.col("role").isin("user", "automation")
    context = F.col("role").isin("developer", "system")
    order = F.struct("line", "seq")
    key = ["file_path", "turn_key"]
    per_turn = m.filter(reply).groupBy(*key).agg(
        F.max_by("content", F.when(F.col("role") == "assistant", order)).alias("assistant"),
        F.max(F.when(F.col("role") == "assistant", F.col("line"))).alias("assistant_line"),
        F.max_by("content", order).alias("reply"), F.max("line").alias("reply_line"),
        F.count_if(context).alias("context_total"))
    prompts = running_sum(m, key, ["line", "seq"], {"context_before": context.cast("int")}).filter(
        F.col("source_event") == "event_msg.user_message")
    turns = corpus.turns.select("file_path", turn, "line", F.coalesce("model", F.lit("unknown")).alias("model"),
                                "effort").groupBy(*key).agg(
        F.min_by(F.struct("model", "effort"), "line").alias("t"))
    tools = corpus.tool_events.groupBy("file_path", turn).agg(F.count(F.lit(1)).alias("tools"))
    usage = corpus.token_usage.groupBy("file_path", turn).agg(F.min_by("usage", "line").alias("usage"))
    timing = corpus.task_timings.groupBy("file_path", turn).agg(
        F.min(F.struct("session_id", "duration_ms", "time_to_first_token_ms", "last_agent_message")).alias("timing"))
    out = (prompts.join(per_turn, key, "left").join(turns, key, "left").join(tools, key, "left")
           .join(usage, key, "left").join(timing, key, "left"))
    out = with_intent(out)
    answer = F.when(F.col("assistant_line") > F.col("line"), js_trim(F.col("assistant"))).when(
        F.col("reply_line") > F.col("line"), js_trim(F.col("reply")))
    return out.select(
        F.concat_ws("#", "file_path", "session_id", F.coalesce("turn_id", F.lit("")), F.col("line").cast("string"))
        .alias("id"), *SESSION, "line", "turn_id", "timestamp", js_trim(F.col("content")).alias("user_message"),
        F.coalesce(answer, "timing.last_agent_message", F.lit("")).alias("assistant_message"),
        F.coalesce("t.model", F.lit("unknown")).alias("model"), "t.effort", "intent_key", "intent_label",
        F.when(F.col("intent_key").isin(*OPERATIONAL), F.col("intent_label")).alias("category"),
        "usage", "timing.duration_ms", "timing.time_to_first_token_ms", F.coalesce("tools", F.lit(0)).alias("tools"),
        (F.coalesce("context_total", F.lit(0)) - F.col("context_before")).alias("context_messages"))
