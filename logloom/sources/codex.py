"""Rollout records (JSON lines) to record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.bounded import bounded_raw
from logloom.functions.content import (array_count, content_to_text, is_automation, message_role,
                                       submitted_prompt_text, tool_event_content)
from logloom.functions.jsonv import at, is_object, long_at, non_empty, num_at, obj_at, parse_line, str_at
from logloom.functions.usage import usage_struct
from logloom.operators.scans import carry_forward
from logloom.schema import Corpus, corpus_from_tables
from logloom.session import stage_table
from logloom.sources.lines import is_blank, session_id_from_path

# Record and payload types.
EVENT_TYPES = ["session_meta", "turn_context", "event_msg", "response_item"]
PAYLOAD_TYPES = [
    "agent_message", "custom_tool_call", "custom_tool_call_output", "exec_command_end", "function_call",
    "function_call_output", "image_generation_call", "image_generation_end", "message", "patch_apply_end",
    "reasoning", "task_complete", "task_started", "thread_name_updated", "token_count", "user_message",
]
ITEM_TOOLS = ["function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output",
              "image_generation_call"]
EVENT_TOOLS = ["exec_command_end", "patch_apply_end", "image_generation_end"]
META = {"provider": "codex", "input_kind": "codex-jsonl", "source_label": "Codex"}


def with_meta(df: DataFrame, meta: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in meta.items()})


def extract_codex(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-blank line with its routing ``kind`` and every field a record table needs.

    With ``carry``, blank lines stay too and these columns come along.
    """
    v, p = F.col("v"), F.col("p")
    base = lines if carry else lines.filter(~is_blank(F.col("value")))
    base = base.withColumn("v", parse_line(F.col("value")))
    base = base.withColumn("malformed", v.isNull()).withColumn("obj", F.coalesce(is_object(v), F.lit(False)))
    base = base.withColumn("p", obj_at(v, "$.payload"))
    base = base.withColumns({"timestamp": str_at(v, "$.timestamp"), "top": str_at(v, "$.type"),
                             "ptype": str_at(p, "$.type")})
    top, ptype = F.col("top"), F.col("ptype")
    alien = F.coalesce((top != "") & ~top.isin(*EVENT_TYPES), F.lit(False))
    kind = (
        F.when(~F.col("obj") | alien, None)
        .when((top == "session_meta") & p.isNotNull(), "session")
        .when((top == "turn_context") & p.isNotNull(), "turn")
        .when(p.isNull(), None)
        .when(ptype.isin("task_started", "task_complete", "user_message", "agent_message", "token_count"), ptype)
        .when((top == "response_item") & (ptype == "message"), "item_message")
        .when(((top == "response_item") & ptype.isin(*ITEM_TOOLS)) | ptype.isin(*EVENT_TOOLS), "tool")
    )
    odd = F.coalesce((ptype != "") & ~ptype.isin(*PAYLOAD_TYPES), F.lit(False))
    unknown = F.col("obj") & (alien | odd | p.isNull())
    base = base.withColumns({"kind": kind, "unknown": unknown})
    k = F.col("kind")

    def only(kinds: tuple[str, ...], c):
        return F.when(k.isin(*kinds), c)

    info = at(p, "$.info")
    prompt = submitted_prompt_text(str_at(p, "$.message"))
    out = base.select(
        *carry, "file_path", "chunk", "line", "malformed", "obj", "unknown", "kind", "timestamp",
        top.alias("top_level_type"), ptype.alias("payload_type"),
        F.when(F.col("unknown"), F.col("value")).alias("value"),
        only(("session",), str_at(p, "$.id")).alias("sid_set"),
        only(("session",), F.struct(str_at(p, "$.cwd").alias("x"))).alias("cwd_set"),
        only(("turn", "task_started", "task_complete"), str_at(p, "$.turn_id")).alias("own_turn"),
        only(("session",), F.struct(str_at(p, "$.timestamp").alias("ts"), str_at(p, "$.originator").alias("originator"),
                                    str_at(p, "$.cli_version").alias("cli_version"),
                                    str_at(p, "$.source").alias("source"),
                                    str_at(p, "$.model_provider").alias("model_provider"))).alias("session"),
        only(("turn",), F.struct(str_at(p, "$.current_date").alias("current_date"),
                                 str_at(p, "$.timezone").alias("timezone"), str_at(p, "$.model").alias("model"),
                                 str_at(p, "$.effort").alias("effort"),
                                 str_at(p, "$.collaboration_mode.mode").alias("collaboration_mode"))).alias("turn"),
        only(("turn", "tool"), str_at(p, "$.cwd")).alias("own_cwd"),
        only(("task_started",), num_at(p, "$.started_at")).alias("started_at"),
        only(("task_complete",), F.struct(
            num_at(p, "$.completed_at").alias("completed_at"), num_at(p, "$.duration_ms").alias("duration_ms"),
            num_at(p, "$.time_to_first_token_ms").alias("time_to_first_token_ms"),
            str_at(p, "$.last_agent_message").alias("last_agent_message"))).alias("done"),
        F.when(k == "user_message", prompt)
        .when(k == "agent_message", F.coalesce(str_at(p, "$.message"), F.lit("")))
        .when(k == "item_message", content_to_text(p, "$.content"))
        .when(k == "tool", tool_event_content(p)).alias("content"),
        only(("item_message",), message_role(str_at(p, "$.role"))).alias("item_role"),
        only(("agent_message", "item_message"), str_at(p, "$.phase")).alias("phase"),
        only(("user_message",), array_count(p, "$.images")).alias("images"),
        only(("user_message",), array_count(p, "$.local_images")).alias("local_images"),
        only(("token_count",), usage_struct(at(info, "$.last_token_usage"))).alias("usage"),
        only(("token_count",), usage_struct(at(info, "$.total_token_usage"))).alias("cumulative_usage"),
        only(("token_count",), long_at(info, "$.model_context_window")).alias("model_context_window"),
        only(("token_count",), F.get_json_object("value", "$.payload.rate_limits")).alias("rate_limits"),
        only(("tool",), F.struct(
            str_at(p, "$.name").alias("name"),
            F.coalesce(str_at(p, "$.call_id"), str_at(p, "$.id")).alias("call_id"),
            long_at(p, "$.exit_code").alias("exit_code"),
            num_at(p, "$.duration.millis").alias("duration_ms"))).alias("tool"),
    )
    return out


def turn_set() -> Column:
    """Turn id that a record puts in force."""
    return F.when(F.col("kind").isin("turn", "task_started"), non_empty(F.col("own_turn")))


def carry_codex(records: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Session id, session directory and turn id in force at every record; ``before`` holds those at the end of what was read earlier."""
    turn = turn_set()
    out = carry_forward(records, ["file_path"], ["line"],
                        {"sid": F.col("sid_set"), "scwd": F.col("cwd_set"), "cur_turn": turn}, F.col("chunk"), before)
    return out.withColumn("session_id", F.coalesce("sid", session_id_from_path(F.col("file_path"))))


def codex_tables(records: DataFrame, line_counts: DataFrame) -> dict[str, DataFrame]:
    """Record tables from carried records; ``line_counts`` has (file_path, line_count) of every file."""
    r = with_meta(records, META)
    key = [*META, "file_path", "session_id", "line"]
    k = F.col("kind")
    auto = is_automation(F.col("content"))
    user = k == "user_message"
    messages = r.filter(k.isin("user_message", "agent_message", "item_message")).select(
        *key, F.lit(0).alias("seq"), F.col("cur_turn").alias("turn_id"), "timestamp",
        F.when(user & auto, "automation").when(user, "user").when(k == "agent_message", "assistant")
        .otherwise(F.col("item_role")).alias("role"),
        F.when(user & auto, "event_msg.automation_message").when(user, "event_msg.user_message")
        .when(k == "agent_message", "event_msg.agent_message").otherwise("response_item.message").alias("source_event"),
        "content", "phase", F.coalesce("images", F.lit(0)).alias("images_count"),
        F.coalesce("local_images", F.lit(0)).alias("local_images_count"))
    timing = r.filter(k.isin("task_started", "task_complete")).withColumn(
        "turn_id", F.when(k == "task_started", non_empty(F.col("own_turn")))
        .otherwise(non_empty(F.coalesce("own_turn", "cur_turn")))).filter(F.col("turn_id").isNotNull())
    timings = timing.groupBy("file_path", "turn_id").agg(
        F.min_by("session_id", "line").alias("session_id"),
        F.max_by(F.struct("started_at"), F.when(k == "task_started", F.col("line"))).alias("s"),
        F.max_by("done", F.when(k == "task_complete", F.col("line"))).alias("d"))
    unknown = r.filter("unknown").withColumn("b", bounded_raw(F.col("value")))
    last_sid = records.groupBy("file_path").agg(
        F.max_by("sid_set", F.when(F.col("sid_set").isNotNull(), F.col("line"))).alias("sid"))
    return {
        "files": with_meta(line_counts.join(last_sid, "file_path", "left"), META).withColumn(
            "session_id", F.coalesce("sid", session_id_from_path(F.col("file_path")))),
        "sessions": r.filter(k == "session").select(
            *key, F.coalesce("session.ts", "timestamp").alias("timestamp"), F.col("cwd_set.x").alias("cwd"),
            "session.originator", "session.cli_version", "session.source", "session.model_provider"),
        "turns": r.filter((k == "turn") & (F.col("own_turn") != "")).select(
            *key, F.col("own_turn").alias("turn_id"), "timestamp",
            F.coalesce("own_cwd", "scwd.x").alias("cwd"), "turn.*"),
        "messages": messages,
        "token_usage": r.filter((k == "token_count") & F.col("usage").isNotNull()).select(
            *key, F.col("cur_turn").alias("turn_id"), "timestamp", "usage", "cumulative_usage",
            "model_context_window", "rate_limits"),
        "task_timings": with_meta(timings, META).select(
            *META, "file_path", "session_id", "turn_id", "s.started_at", "d.*",
            F.col("s").isNotNull().alias("has_start"), F.col("d").isNotNull().alias("has_end")),
        "tool_events": r.filter(k == "tool").select(
            *key, F.lit(0).alias("seq"), F.col("cur_turn").alias("turn_id"), "timestamp",
            F.col("payload_type").alias("event_type"), "tool.name", "tool.call_id", "content",
            F.col("own_cwd").alias("cwd"), "tool.exit_code", "tool.duration_ms"),
        "unknown_events": unknown.select(*key, "timestamp", "top_level_type", "payload_type", "b.raw_truncated",
                                         "b.raw"),
        "warnings": malformed_warnings(records, META),
    }


def malformed_warnings(records: DataFrame, meta: dict[str, str]) -> DataFrame:
    return with_meta(records.filter("malformed"), meta).select(
        *meta, "file_path", "line", F.lit("malformed_json").alias("code"),
        F.lit("The line is not valid JSON.").alias("message"))


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_path").agg(F.max("line").alias("line_count"))


def normalize_codex(lines: DataFrame, line_counts: DataFrame | None = None, stage: bool = True) -> Corpus:
    """Corpus of rollout lines ``(file_path, chunk, line, value)``.

    Extracted and carried records are staged once each: the text is parsed once, the ordered scan runs once, and the
    nine tables are plain projections.
    """
    keep = stage_table if stage else (lambda df: df)
    records = keep(carry_codex(keep(extract_codex(lines))))
    counts = keep(count_lines(lines)) if line_counts is None else line_counts
    return corpus_from_tables(lines.sparkSession, codex_tables(records, counts))
