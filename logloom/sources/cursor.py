"""Chat key/value stores and Markdown chat exports to record tables."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.content import array_count, content_to_text, cursor_tool_content, js_trim
from logloom.functions.jsonv import arr_at, at, is_object, num_at, parse_line, str_at
from logloom.functions.text import WS
from logloom.functions.times import iso_utc, parse_ts
from logloom.functions.usage import usage_struct_cursor
from logloom.operators.scans import ranked, running_sum
from logloom.schema import Corpus, corpus_from_tables
from logloom.session import stage_table
from logloom.sources.codex import with_meta
from logloom.sources.lines import plain_path, session_id_from_path

KV_META = {"provider": "cursor", "input_kind": "cursor-vscdb", "source_label": "Cursor"}
MD_META = {"provider": "cursor", "input_kind": "cursor-markdown", "source_label": "Cursor"}
HEADER_KEY = "composer.composerHeaders"

# Role words of Markdown exports.
USER_WORDS = ["user", "human", "you"]
ASSISTANT_WORDS = ["assistant", "cursor", "ai"]
ROLE_HEADING = r"(?i)\A#{1,6}WS+(user|human|you|assistant|cursor|ai)WS*\z".replace("WS", WS)
ROLE_BOLD = r"(?i)\A\*\*(user|human|you|assistant|cursor|ai)\*\*:?WS*(.*)\z".replace("WS", WS)
ROLE_PLAIN = r"(?i)\A(user|human|you|assistant|cursor|ai):WS+(.*)\z".replace("WS", WS)


def timestamp_from_any(v: Column, path: str) -> Column:
    """ISO text of a text or epoch value (above 1e10 milliseconds, else seconds); unreadable text stays as it is."""
    text, number = str_at(v, path), num_at(v, path)
    millis = F.when(number > 10_000_000_000, number).otherwise(number * 1000)
    return F.when(js_trim(text) != "", F.coalesce(iso_utc(parse_ts(text)), text)).when(
        number.isNotNull(), iso_utc(F.timestamp_millis(millis.cast("bigint"))))


def read_vscdb(files: DataFrame) -> DataFrame:
    """Key/value rows of state files: (file_path, source, row_number, key, value, code).

    ``files`` has (path, content) as the binary-file source gives them; every task opens the files of its own
    rows from memory.  Files that cannot be used give one row with a warning ``code``.
    """
    header_key = HEADER_KEY

    def text(value):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else value if isinstance(value, str) else None

    def kv_rows(path: str, content: bytes):
        def failed(code, note):
            return [(path, None, 0, None, None, code, note)]

        try:
            db = sqlite3.connect(":memory:")
            db.deserialize(content)
            tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        except Exception as error:
            return failed("cursor_vscdb_open_failed", str(error))
        if "cursorDiskKV" not in tables:
            return failed("unsupported_cursor_vscdb",
                          "Cursor SQLite database does not contain cursorDiskKV chat storage.")
        try:
            out = [(path, "bubble", i, text(k), text(v), None, None) for i, (k, v) in enumerate(
                db.execute("SELECT key, value FROM cursorDiskKV WHERE key LIKE 'bubbleId:%'"), start=1)]
            if "ItemTable" in tables:
                out += [(path, "header", 0, k, text(v), None, None) for k, v in db.execute(
                    "SELECT key, value FROM ItemTable WHERE key = ?", [header_key])]
            return out or [(path, "empty", 0, None, None, None, None)]
        except Exception as error:
            return failed("cursor_vscdb_parse_failed", str(error))

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(kv_rows(path, bytes(content)),
                                   columns=["path", "source", "row_number", "key", "value", "code", "note"])

    out = files.select("path", "content").mapInPandas(
        rows, "path string, source string, row_number bigint, key string, value string, code string, note string")
    return out.withColumn("file_path", plain_path(F.col("path"))).drop("path")


def composer_headers(kv: DataFrame) -> DataFrame:
    """(file_path, session_id, title, header_ts, workspace_id) of the chats a state file lists."""
    v = parse_line(F.col("value"))
    one = kv.filter(F.col("source") == "header").select("file_path", F.explode(arr_at(v, "$.allComposers")).alias("c"))
    c = F.col("c")
    rows = one.filter(is_object(c)).select(
        "file_path", str_at(c, "$.composerId").alias("session_id"),
        F.coalesce(str_at(c, "$.name"), str_at(c, "$.subtitle")).alias("title"),
        timestamp_from_any(c, "$.createdAt").alias("header_ts"),
        str_at(c, "$.workspaceIdentifier.id").alias("workspace_id")).filter(F.col("session_id") != "")
    return rows.dropDuplicates(["file_path", "session_id"])


def workspace_dirs(workspaces: DataFrame) -> DataFrame:
    """(storage, workspace_id, cwd) from ``workspace.json`` files given as (path, value)."""
    path = plain_path(F.col("path"))
    folder = str_at(parse_line(F.col("value")), "$.folder")
    local = F.when(folder.startswith("file://"),
                   F.url_decode(F.regexp_replace(F.regexp_replace(folder, r"\Afile://(localhost)?", ""), r"\+", "%2B"))
                   ).otherwise(folder)
    pattern = r"\A(.*)/workspaceStorage/([^/]+)/workspace\.json\z"
    return workspaces.select(F.regexp_extract(path, pattern, 1).alias("storage"),
                             F.regexp_extract(path, pattern, 2).alias("workspace_id"), local.alias("cwd")).filter(
        F.col("workspace_id") != "")


def storage_dir(path: Column) -> Column:
    """Folder that holds a state file's ``workspaceStorage``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"\A(.*)/globalStorage/[^/]+\z", 1), F.lit("")),
                      F.nullif(F.regexp_extract(path, r"\A(.*)/workspaceStorage/[^/]+/[^/]+\z", 1), F.lit("")))


def normalize_cursor_kv(kv: DataFrame, workspaces: DataFrame | None = None) -> Corpus:
    """Corpus of key/value rows (see :func:`read_vscdb`); every chat is one logical file.

    Bubbles are numbered by creation time, then store order, with a ranking that does not gather a chat in one task.
    """
    spark = kv.sparkSession
    parts = F.split("key", ":")
    bubbles = kv.filter((F.col("source") == "bubble") & F.col("key").startswith("bubbleId:")).select(
        "file_path", "row_number", parts.getItem(1).alias("session_id"), F.get(parts, F.lit(2)).alias("turn_id"),
        "value").filter((F.col("session_id") != "") & (F.col("turn_id") != ""))
    v = F.col("v")
    bubbles = bubbles.withColumn("v", parse_line(F.col("value")))
    bubbles = bubbles.withColumn("ok", F.coalesce(is_object(v), F.lit(False)))
    number = num_at(v, "$.type")
    word = F.coalesce(str_at(v, "$.role"), str_at(v, "$.type"))
    role = F.when(number == 1, "user").when(number == 2, "assistant").when(word.isin("user", "assistant"), word)
    tools = F.transform(arr_at(v, "$.toolResults"), lambda t, i: F.struct(
        is_object(t).alias("ok"), (i + 1).cast("int").alias("seq"),
        F.coalesce(str_at(t, "$.type"), F.lit("tool_result")).alias("event_type"),
        F.coalesce(str_at(t, "$.name"), str_at(t, "$.toolName")).alias("name"),
        str_at(t, "$.id").alias("own_id"), cursor_tool_content(t).alias("content")))
    fields = bubbles.filter("ok").select(
        "file_path", "session_id", "turn_id", "row_number", timestamp_from_any(v, "$.createdAt").alias("timestamp"),
        role.alias("role"),
        js_trim(F.coalesce(str_at(v, "$.text"), str_at(v, "$.message"), content_to_text(v, "$.content"))).alias("content"),
        F.coalesce(str_at(v, "$.type"), F.regexp_replace(number.cast("string"), r"\.0\z", "")).alias("payload_type"),
        array_count(v, "$.images").alias("images_count"),
        usage_struct_cursor(at(v, "$.tokenCount")).alias("usage"),
        num_at(v, "$.turnDurationMs").alias("duration_ms"), F.filter(tools, lambda t: t["ok"]).alias("tools"),
        F.when(role.isNull(), F.col("value")).alias("raw"))
    placed = stage_table(ranked(fields, ["file_path", "session_id"],
                                [F.coalesce("timestamp", F.lit("")), F.col("row_number")], "line"))

    headers = composer_headers(kv).withColumn("storage", storage_dir(F.col("file_path")))
    if workspaces is not None:
        headers = headers.join(workspace_dirs(workspaces), ["storage", "workspace_id"], "left")
    else:
        headers = headers.withColumn("cwd", F.lit(None).cast("string"))
    headers = headers.select("file_path", "session_id", "title", "header_ts", "cwd")
    chats = placed.groupBy("file_path", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role").isNotNull() & (F.col("content") != "")).alias("said"))
    known = headers.join(chats, ["file_path", "session_id"], "full_outer")
    rows = placed.join(headers, ["file_path", "session_id"], "left")
    rows = with_meta(rows, KV_META).withColumn("provider_conversation_id", F.col("session_id"))
    key = [*KV_META, "title", "provider_conversation_id", "file_path", "session_id", "line"]

    broken = kv.filter(F.col("code").isNotNull()).select("file_path", F.lit(0).alias("line"), "code",
                                                         F.col("note").alias("message"))
    bad = bubbles.filter(~F.col("ok")).select(
        "file_path", F.col("row_number").alias("line"), F.lit("malformed_cursor_record").alias("code"),
        F.concat(F.lit("Could not parse Cursor bubble "), F.col("turn_id"), F.lit(".")).alias("message"))
    usable = kv.filter(F.col("code").isNull()).select("file_path").distinct()
    silent = usable.join(known.select("file_path").distinct(), "file_path", "left_anti").select(
        "file_path", F.lit(0).alias("line"), F.lit("cursor_vscdb_no_chats").alias("code"),
        F.lit("No Cursor chat bubbles were found in cursorDiskKV.").alias("message"))
    warnings = broken.unionByName(bad).unionByName(silent)

    # A store's warnings belong to its first chat, which stays even without messages.
    first_chat = known.groupBy("file_path").agg(
        F.min_by("session_id", F.struct(F.coalesce("header_ts", F.lit("")), "session_id")).alias("session_id"))
    warned = warnings.select("file_path").distinct()
    keep = known.filter(F.col("said") > 0).select("file_path", "session_id").unionByName(
        first_chat.join(warned, "file_path", "left_semi").select("file_path", "session_id")).distinct()
    kept = known.join(keep, ["file_path", "session_id"], "left_semi")
    empty = kv.select("file_path").distinct().join(kept.select("file_path").distinct(), "file_path", "left_anti")
    files = kept.select("file_path", "session_id", "title", F.col("session_id").alias("provider_conversation_id"),
                        F.coalesce("n", F.lit(0)).alias("line_count"))
    files = files.unionByName(empty.select("file_path", session_id_from_path(F.col("file_path")).alias("session_id"),
                                           F.lit(0).alias("line_count")), allowMissingColumns=True)
    rows = rows.join(keep, ["file_path", "session_id"], "left_semi")
    said = F.col("content") != ""
    return corpus_from_tables(spark, {
        "files": with_meta(files, KV_META),
        "sessions": with_meta(kept, KV_META).select(
            *KV_META, "title", F.col("session_id").alias("provider_conversation_id"), "file_path", "session_id",
            F.lit(0).alias("line"), F.col("header_ts").alias("timestamp"), "cwd"),
        "messages": rows.filter(F.col("role").isNotNull() & said).select(
            *key, F.lit(0).alias("seq"), "turn_id", "timestamp", "role",
            F.concat(F.lit("cursor."), F.col("role"), F.lit("_message")).alias("source_event"), "content",
            "images_count", F.lit(0).alias("local_images_count")),
        "token_usage": rows.filter(F.col("usage").isNotNull()).select(*key, "turn_id", "timestamp", "usage"),
        "task_timings": rows.filter(F.col("duration_ms").isNotNull()).groupBy(
            *key[:-1], "turn_id").agg(F.max_by("duration_ms", "line").alias("duration_ms")),
        "tool_events": rows.select(*key, "turn_id", "timestamp", "cwd", F.explode("tools").alias("t")).select(
            *key, "turn_id", "timestamp", "cwd", "t.seq", "t.event_type", "t.name",
            F.coalesce("t.own_id", F.concat("turn_id", F.lit(":tool:"), F.col("t.seq").cast("string"))).alias("call_id"),
            "t.content"),
        "unknown_events": rows.filter(F.col("role").isNull() & said).select(
            *key, "timestamp", F.lit("cursor.bubble").alias("top_level_type"), "payload_type", "raw"),
        "warnings": with_meta(warnings, KV_META),
    })


def _role(word: Column) -> Column:
    return F.when(F.lower(word).isin(*USER_WORDS), "user").when(F.lower(word).isin(*ASSISTANT_WORDS), "assistant")


def normalize_cursor_markdown(lines: DataFrame) -> Corpus:
    """Corpus of Markdown chat exports, given as lines ``(file_path, chunk, line, value)``."""
    spark = lines.sparkSession
    text = js_trim(F.col("value"))
    title_line = F.col("value").rlike(rf"\A#{WS}+[^{WS[1:]}")
    heading = _role(F.nullif(F.regexp_extract(text, ROLE_HEADING, 1), F.lit("")))
    bold = text.rlike(ROLE_BOLD)
    inline = _role(F.when(bold, F.regexp_extract(text, ROLE_BOLD, 1))
                   .otherwise(F.nullif(F.regexp_extract(text, ROLE_PLAIN, 1), F.lit(""))))
    rest = F.when(bold, F.regexp_extract(text, ROLE_BOLD, 2)).otherwise(F.regexp_extract(text, ROLE_PLAIN, 2))
    marked = lines.withColumns({
        "role_set": F.coalesce(heading, inline),
        "body": F.when(heading.isNotNull(), None).when(inline.isNotNull(), F.nullif(js_trim(rest), F.lit("")))
        .otherwise(F.col("value")),
        "title_at": title_line})
    placed = running_sum(marked, ["file_path"], ["line"], {"section": F.col("role_set").isNotNull().cast("int")},
                         F.col("chunk"))
    # A section is one chat message, so its lines belong together by nature.
    sections = placed.filter(F.col("section") > 0).groupBy("file_path", "section").agg(
        F.min("line").alias("line"), F.min_by("role_set", "line").alias("role"),
        js_trim(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("body").isNotNull(), F.struct("line", "body")))), lambda x: x["body"]), "\n")).alias("content"))
    base_name = F.element_at(F.split("file_path", "/"), -1)
    per_file = marked.groupBy("file_path").agg(
        F.max("line").alias("line_count"), F.min_by("value", F.when(F.col("title_at"), F.col("line"))).alias("t"))
    files = with_meta(per_file, MD_META).select(
        *MD_META, F.coalesce(js_trim(F.regexp_replace("t", rf"\A#{WS}+", "")), base_name).alias("title"),
        session_id_from_path(F.col("file_path")).alias("provider_conversation_id"), "file_path",
        session_id_from_path(F.col("file_path")).alias("session_id"), "line_count")
    messages = sections.filter(F.col("content") != "").join(files.drop("line_count"), "file_path").withColumns({
        "seq": F.lit(0), "source_event": F.concat(F.lit("cursor."), F.col("role"), F.lit("_message")),
        "images_count": F.lit(0), "local_images_count": F.lit(0)})
    silent = files.join(messages.select("file_path").distinct(), "file_path", "left_anti").withColumns({
        "line": F.lit(0), "code": F.lit("cursor_markdown_no_messages"),
        "message": F.lit("No Cursor Markdown user or assistant sections were found.")})
    return corpus_from_tables(spark, {
        "files": files, "sessions": files.withColumn("line", F.lit(0)), "messages": messages, "warnings": silent})
