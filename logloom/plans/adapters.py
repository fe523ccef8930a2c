"""Record tables derived from the driver's test tables, as SQL in two dialects.

Conversations become messages, sessions and turns; events become token usage, tool events and unknown events.
The same views feed the engine and the comparison SQL, so a comparison checks the operator alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schema import USAGE_FIELDS, Corpus, corpus_from_tables
from logloom.session import configure

# Synthetic prompts, one or more per rule.
PHRASES = [
    "Yes", "  go ahead!", "Sounds good", "please deploy to production", "commit", "Are all files committed?",
    "run the app", "please review the diff", "Could you run the tests", "Update the readme please",
    "fix the crash in the parser", "Add a loading indicator because it feels broken", "the totals look wrong",
    "Create a plan for the cache", "count rows by day and make a chart", "Draft a blog post about sessions",
    "I want the app to refresh often", "Rename the helper and simplify it", "Improve the layout of this section",
    "implement the importer", "Why is the cache cold?", "for context here is the log",
    "make sure it stays small", "Okay, please commit", "I would like you to explain the join", "ok", "release notes for may",
    "is everything in the repo pushed?", "mail ana@example.org, token=abc123 and /Users/ana/x", "Look at  the\nnumbers",
]

TABLES = ["conversations", "events", "documents", "labels"]


def _sql(dialect: str) -> dict[str, str]:
    spark = dialect == "spark"

    def iso(sec: str) -> str:
        return (f"date_format(timestamp_seconds({sec}), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")" if spark
                else f"strftime(make_timestamp(1000000 * ({sec})), '%Y-%m-%dT%H:%M:%S.000Z')")

    iso_ts = ("date_format(CAST(ts AS timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")" if spark
              else "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')")
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)" if spark else "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    newline = "char(10)" if spark else "chr(10)"
    text = "STRING" if spark else "VARCHAR"

    def quoted(p: str) -> str:
        return "||".join(f"'{part}'" for part in p.replace("'", "''").split("\n")).replace("'||'", f"'||{newline}||'")

    def phrase(n: str) -> str:
        cases = " ".join(f"WHEN {i} THEN {quoted(p)}" for i, p in enumerate(PHRASES))
        return f"CASE ({n}) % {len(PHRASES)} {cases} END"

    def provider(c: str) -> str:
        return f"CASE {c} % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'cursor' END"

    def meta(c: str) -> str:
        return (f"{provider(c)} AS provider, CASE {c} % 3 WHEN 0 THEN 'codex-jsonl' WHEN 1 THEN 'claude-jsonl' "
                f"ELSE 'cursor-markdown' END AS input_kind, CASE {c} % 3 WHEN 0 THEN 'Codex' WHEN 1 THEN 'Claude Code' "
                f"END AS source_label, CASE WHEN {c} % 3 = 1 THEN 'Chat ' || {c} END AS title, "
                f"CASE WHEN {c} % 3 <> 0 THEN 'conv-' || {c} END AS provider_conversation_id, "
                f"'/logs/c' || {c} || '.jsonl' AS file_path")

    session = "CASE WHEN conv_id % 8 = 7 AND turn >= 4 THEN 'sx' ELSE 's' END || conv_id"
    sec = "1704067200 + conv_id * 21600 + turn * CASE WHEN conv_id % 5 = 0 THEN 18000 ELSE 1200 END"
    cwd = ("CASE conv_id % 6 WHEN 0 THEN '/home/dev/proj-a' WHEN 1 THEN '/home/dev/.codex/worktrees/w1/proj-b' "
           "WHEN 2 THEN '/srv/checkout/team-tools/x' WHEN 4 THEN '/home/dev/proj-' || (conv_id % 7) "
           "WHEN 5 THEN '/Users/ana/work/proj-c' END")
    usage = (f"CAST(floor(value) AS BIGINT) AS input_tokens, {k} % 5 AS cached_input_tokens, "
             f"CAST(0 AS BIGINT) AS cache_creation_input_tokens, {k} % 5 AS cache_read_input_tokens, "
             f"greatest(0, CAST(floor(value) AS BIGINT) - {k} % 5) + copy AS fresh_input_tokens, {k} AS output_tokens, "
             f"{k} % 3 AS reasoning_output_tokens, CAST(floor(value) AS BIGINT) + {k} AS total_tokens")
    turn_no = "CAST(floor(turn / 2) AS BIGINT)"
    event_turn = "CASE WHEN event_id % 7 <> 0 THEN 't' || (event_id % 4) END AS turn_id"
    return {
        "lg_conv": f"""SELECT conv_id, turn, role, text, {session} AS session_id, {sec} AS sec, {turn_no} AS turn_no,
            role = 'user' AND conv_id % 3 = 0 AND conv_id % 7 = 0 AND turn = 4 AS auto FROM conversations""",
        "lg_messages": f"""SELECT {meta('conv_id')}, session_id, turn + 1 + CASE WHEN alone THEN 1000 ELSE 0 END AS line, CAST(0 AS INT) AS seq,
            CASE WHEN NOT (turn = 5 AND conv_id % 4 = 1) THEN 't' || turn_no END AS turn_id,
            CASE WHEN conv_id % 11 = 0 AND turn = 3 THEN NULL WHEN conv_id % 13 = 0 AND turn = 2 THEN 'n/a'
                 ELSE {iso('sec')} END AS timestamp,
            CASE WHEN auto THEN 'automation' ELSE role END AS role,
            CASE WHEN auto THEN 'event_msg.automation_message'
                 WHEN conv_id % 3 = 0 AND role = 'user' THEN 'event_msg.user_message'
                 WHEN conv_id % 3 = 0 AND role = 'assistant' THEN 'event_msg.agent_message'
                 WHEN conv_id % 3 = 0 THEN 'response_item.message'
                 ELSE {provider('conv_id')} || '.' || role || '_message' END AS source_event,
            CASE WHEN role <> 'user' THEN CASE WHEN conv_id % 12 = 0 AND turn = 1 THEN ' ' ELSE text END
                 WHEN alone THEN {phrase('conv_id + turn')} WHEN conv_id % 7 = 3 THEN text
                 ELSE {phrase('conv_id * 3 + turn')} || ' ' || text END AS content,
            CAST(NULL AS {text}) AS phase, CAST(0 AS INT) AS images_count, CAST(0 AS INT) AS local_images_count
            FROM (SELECT *, false AS alone FROM lg_conv UNION ALL
                  SELECT *, true FROM lg_conv WHERE role = 'user' AND turn % 2 = 0 AND conv_id % 2 = 0 AND conv_id % 7 <> 3) m""",
        "lg_files": f"""SELECT {meta('conv_id')}, session_id, line_count FROM (
            SELECT conv_id, max_by(session_id, turn) AS session_id, max(turn) + 1 AS line_count FROM lg_conv GROUP BY conv_id
            UNION ALL SELECT DISTINCT user_id AS conv_id, 's' || user_id AS session_id, CAST(0 AS BIGINT) AS line_count
            FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)) f""",
        "lg_sessions": f"""SELECT {meta('conv_id')}, session_id, line, {iso('sec - 60')} AS timestamp, cwd FROM (
            SELECT conv_id, 's' || conv_id AS session_id, CAST(0 AS BIGINT) AS line, min(sec) AS sec, {cwd} AS cwd
            FROM lg_conv GROUP BY conv_id
            UNION ALL SELECT conv_id, session_id, CAST(5 AS BIGINT), min(sec), '/home/dev/proj-z' FROM lg_conv
            WHERE conv_id % 8 = 7 AND turn >= 4 GROUP BY conv_id, session_id) s""",
        "lg_turns": f"""SELECT {meta('conv_id')}, session_id, line, 't' || turn_no AS turn_id, {iso('sec')} AS timestamp,
            CASE WHEN conv_id % 6 = 3 THEN '/home/dev/from-turn' END AS cwd, model, 'high' AS effort FROM (
            SELECT conv_id, session_id, turn_no, min(turn) + 1 AS line, min(sec) AS sec,
            CASE WHEN (conv_id + turn_no) % 4 < 3 THEN 'm' || ((conv_id + turn_no) % 4) END AS model
            FROM lg_conv GROUP BY conv_id, session_id, turn_no
            UNION ALL SELECT conv_id, session_id, turn_no, min(turn) + 2, min(sec), 'm9' FROM lg_conv
            WHERE conv_id % 9 = 0 GROUP BY conv_id, session_id, turn_no) t""",
        "lg_usage": f"""SELECT {meta('user_id')}, 's' || user_id AS session_id,
            1000 + event_id + 5000000 * copy AS line, {event_turn}, {iso_ts} AS timestamp, {usage} FROM (
            SELECT *, CAST(0 AS BIGINT) AS copy FROM events
            UNION ALL SELECT *, CAST(1 AS BIGINT) AS copy FROM events WHERE event_id % 10 = 0) e""",
        "lg_tools": f"""SELECT {meta('user_id')}, 's' || user_id AS session_id, 1000 + event_id AS line,
            CAST(1 AS INT) AS seq, {event_turn}, {iso_ts} AS timestamp, 'exec_command_end' AS event_type,
            'shell' AS name, props AS content FROM events WHERE event_type = 'click'""",
        "lg_unknown": f"""SELECT {meta('user_id')}, 's' || user_id AS session_id, 1000 + event_id AS line,
            {iso_ts} AS timestamp, event_type AS top_level_type FROM events WHERE event_type = 'error'""",
        "lg_timings": f"""SELECT {meta('conv_id')}, session_id, 't' || turn_no AS turn_id,
            CAST(conv_id * 100 + turn_no AS DOUBLE) AS duration_ms, 'bye ' || conv_id AS last_agent_message
            FROM (SELECT DISTINCT conv_id, session_id, turn_no FROM lg_conv WHERE conv_id % 3 <> 2) t""",
        "lg_warnings": f"""SELECT {meta('conv_id')}, turn + 1 AS line, 'malformed_json' AS code
            FROM conversations WHERE conv_id % 10 = 3 AND turn = 1""",
        "lg_prompts": f"""SELECT 'codex' AS provider, '/docs/' || source AS file_path, 'd' || source AS session_id,
            doc_id AS line, CAST(0 AS INT) AS seq, CAST(NULL AS {text}) AS turn_id,
            {iso('1704067200 + doc_id * 60')} AS timestamp, 'user' AS role, 'event_msg.user_message' AS source_event,
            CASE doc_id % 4 WHEN 0 THEN {phrase('doc_id')} || {newline} || text WHEN 1 THEN {phrase('doc_id')} || ' ' || text ELSE text END
            AS content FROM documents""",
        "lg_gold": f"""SELECT 'g' || d.doc_id AS id, {phrase('d.doc_id * 7')} || ' ' || d.text AS message,
            CASE WHEN quality = 1 AND toxic = 0 THEN 'feature-design' WHEN toxic = 1 THEN 'bug-fixes'
                 ELSE 'git-commands' END AS expected_key,
            CASE WHEN d.doc_id % 3 = 0 THEN 'implementation' END AS previous_key
            FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    }


def duckdb_views() -> str:
    """The views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in _sql("duckdb").items())


@lru_cache(maxsize=8)
def table_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views over the parquet tables of one scale (lazy plans, built once per session)."""
    configure(spark)
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for name, query in _sql("spark").items():
        used = {t: df for t, df in named.items() if re.search(rf"\b{t}\b", query)}
        marked = re.sub("|".join(rf"\b{t}\b(?!\.)" for t in used), lambda m: "{" + m.group() + "}", query)
        named[name] = spark.sql(marked, **used)
    return named


@lru_cache(maxsize=8)
def corpus_from_sf(spark: SparkSession, sf_dir: str) -> Corpus:
    """A corpus of all record tables over the test tables."""
    v = table_views(spark, sf_dir)
    usage = F.struct(*USAGE_FIELDS)
    return corpus_from_tables(spark, {
        "files": v["lg_files"], "sessions": v["lg_sessions"], "turns": v["lg_turns"], "messages": v["lg_messages"],
        "token_usage": v["lg_usage"].withColumn("usage", usage), "task_timings": v["lg_timings"],
        "tool_events": v["lg_tools"], "unknown_events": v["lg_unknown"], "warnings": v["lg_warnings"]})


@lru_cache(maxsize=8)
def prompt_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents as codex prompts, one file per source."""
    return corpus_from_tables(spark, {"messages": table_views(spark, sf_dir)["lg_prompts"]})
