"""Claude-style records (JSON lines) to record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.bounded import bounded_raw
from logloom.functions.content import block_count, claude_message_text, content_to_text, js_trim, message_role
from logloom.functions.jsonv import (arr_at, at, is_object, json_text, non_empty, obj_at, parse_line, str_at)
from logloom.functions.usage import usage_struct
from logloom.operators.scans import carry_forward
from logloom.schema import Corpus, corpus_from_tables
from logloom.session import stage_table
from logloom.sources.codex import count_lines, malformed_warnings, with_meta
from logloom.sources.lines import CLAUDE_TYPES, is_blank, session_id_from_path

META = {"provider": "claude", "input_kind": "claude-jsonl", "source_label": "Claude Code"}


def extract_claude(lines: DataFrame) -> DataFrame:
    """One row per non-blank line with every field a record table needs."""
    v, m = F.col("v"), F.col("m")
    base = lines.filter(~is_blank(F.col("value"))).withColumn("v", parse_line(F.col("value")))
    base = base.withColumns({"malformed": v.isNull(), "obj": F.coalesce(is_object(v), F.lit(False)),
                             "m": obj_at(v, "$.message"), "top": str_at(v, "$.type")})
    top = F.col("top")
    alien = F.coalesce((top != "") & ~top.isin(*CLAUDE_TYPES), F.lit(False))
    kind = (F.when(~F.col("obj"), None).when(alien, "unknown").when(m.isNotNull(), "message")
            .when(top == "system", "system").otherwise("unknown"))
    base = base.withColumn("kind", kind)
    role = message_role(F.coalesce(str_at(m, "$.role"), top))

    def tool(block, pos):
        use = str_at(block, "$.type") == "tool_use"
        return F.struct(
            (pos + 1).cast("int").alias("seq"), str_at(block, "$.type").alias("event_type"),
            F.when(use, str_at(block, "$.name")).alias("name"),
            F.when(use, str_at(block, "$.id")).otherwise(str_at(block, "$.tool_use_id")).alias("call_id"),
            F.when(use, json_text(at(block, "$.input"))).otherwise(content_to_text(block, "$.content")).alias("content"))

    tools = F.filter(F.transform(arr_at(m, "$.content"), tool),
                     lambda t: t["event_type"].isin("tool_use", "tool_result"))
    return base.select(
        "file_path", "chunk", "line", "malformed", "obj", "kind", top.alias("top_level_type"),
        str_at(v, "$.timestamp").alias("timestamp"),
        F.when(F.col("kind") == "unknown", F.col("value")).alias("value"),
        non_empty(F.coalesce(str_at(v, "$.sessionId"), str_at(v, "$.session_id"))).alias("sid_set"),
        str_at(v, "$.cwd").alias("cwd_set"),
        F.when(top.isin("summary", "title"), F.coalesce(str_at(v, "$.summary"), str_at(v, "$.title"))).alias("title_set"),
        F.coalesce(str_at(v, "$.uuid"), str_at(m, "$.id")).alias("own_turn"),
        non_empty(str_at(m, "$.model")).alias("model"),
        usage_struct(at(m, "$.usage")).alias("usage"),
        role.alias("role"),
        F.when(F.col("kind") == "message", js_trim(claude_message_text(m)))
        .when(F.col("kind") == "system", content_to_text(v, "$.content")).alias("content"),
        block_count(m, "$.content", "image").alias("images"),
        F.when(F.col("kind") == "message", tools).alias("tools"),
    )


def carry_claude(records: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Session id, directory and title in force at every record; ``before`` holds those at the end of what was read earlier."""
    return carry_forward(records.filter("obj"), ["file_path"], ["line"], {
        "sid": F.col("sid_set"), "cwd": F.col("cwd_set"), "title": F.col("title_set")}, F.col("chunk"), before)


def claude_tables(records: DataFrame, carried: DataFrame, line_counts: DataFrame) -> dict[str, DataFrame]:
    default = session_id_from_path(F.col("file_path"))
    carried = with_meta(carried, META).withColumns({
        "session_id": F.coalesce("sid", default), "provider_conversation_id": F.col("sid")})
    carried = carried.withColumn(
        "turn_id", F.coalesce("own_turn", F.concat_ws(":", "session_id", F.col("line").cast("string"))))
    key = [*META, "title", "provider_conversation_id", "file_path", "session_id", "line"]
    k = F.col("kind")

    def earliest(name: str):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("line"))).alias(name)

    per_session = carried.groupBy("file_path", "session_id").agg(
        F.min("line").alias("line"), F.min_by(F.struct("timestamp"), "line")["timestamp"].alias("timestamp"),
        earliest("cwd"), earliest("title"), earliest("provider_conversation_id"))
    bare = line_counts.join(per_session.select("file_path").distinct(), "file_path", "left_anti").select(
        "file_path", default.alias("session_id"), F.lit(0).cast("bigint").alias("line"))
    sessions = with_meta(per_session.unionByName(bare, allowMissingColumns=True), META)
    last_sid = records.groupBy("file_path").agg(
        F.max_by("sid_set", F.when(F.col("sid_set").isNotNull() & F.col("obj"), F.col("line"))).alias("sid"))
    is_msg = k == "message"
    messages = carried.filter((is_msg & ((F.col("content") != "") | F.col("role").isin("assistant", "system")))
                              | (k == "system"))
    role = F.when(k == "system", F.lit("system")).otherwise(F.col("role"))
    unknown = carried.filter(k == "unknown").withColumn("b", bounded_raw(F.col("value")))
    return {
        "files": with_meta(line_counts.join(last_sid, "file_path", "left"), META).withColumn(
            "session_id", F.coalesce("sid", default)),
        "sessions": sessions,
        "turns": carried.filter(is_msg & F.col("model").isNotNull()).select(*key, "turn_id", "timestamp", "cwd",
                                                                              "model"),
        "messages": messages.select(
            *key, F.lit(0).alias("seq"), "turn_id", "timestamp", role.alias("role"),
            F.concat(F.lit("claude."), role, F.lit("_message")).alias("source_event"), "content",
            F.when(is_msg, F.col("images")).otherwise(0).alias("images_count"),
            F.lit(0).alias("local_images_count")),
        "token_usage": carried.filter(is_msg & F.col("usage").isNotNull()).select(*key, "turn_id", "timestamp",
                                                                                     "usage"),
        "tool_events": carried.filter(is_msg).select(*key, "turn_id", "timestamp", F.explode("tools").alias("t"))
        .select(*key, "turn_id", "timestamp", "t.*"),
        "unknown_events": unknown.select(*key, "timestamp", "top_level_type", "b.raw_truncated", "b.raw"),
        "warnings": malformed_warnings(records, META),
    }


def normalize_claude(lines: DataFrame, line_counts: DataFrame | None = None, stage: bool = True) -> Corpus:
    """Corpus of lines ``(file_path, chunk, line, value)``; every file has at least one session row."""
    keep = stage_table if stage else (lambda df: df)
    records = keep(extract_claude(lines))
    counts = keep(count_lines(lines)) if line_counts is None else line_counts
    return corpus_from_tables(lines.sparkSession, claude_tables(records, keep(carry_claude(records)), counts))
