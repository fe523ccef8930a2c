"""Audit worklogs: sections per session, redaction, and merging into existing worklogs.

A worklog is a table of text blocks with an order, so a session of any length is written by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.content import is_submitted
from logloom.functions.text import (WS, blockquote, provider_label, quote_key, redact_inline, redact_text,
                                    session_marker)
from logloom.functions.times import day_key, in_range
from logloom.operators.context import SESSION, session_contexts
from logloom.operators.scans import running_sum
from logloom.operators.scope import Scope, provider_in_scope, repo_scope
from logloom.schema import Corpus, record_provider
from logloom.session import stage_table

MARKER_TAG = "logloom:audit-session"
NO_RESPONSE = "_No AI response was captured for this message in the parsed log._"


@dataclass(frozen=True)
class AuditOptions(Scope):
    repo_path: str | None = None
    include_responses: bool = True
    raw: bool = False
    title: str = "AI Worklog"
    generated_at: str = ""
    marker_tag: str = MARKER_TAG

    def text(self, c):
        return c if self.raw else redact_text(c)

    def inline(self, c):
        return F.trim(F.regexp_replace(c, WS + "+", " ")) if self.raw else redact_inline(c)


def _audit_files(corpus: Corpus, o: AuditOptions) -> DataFrame:
    ctx = session_contexts(corpus, o.aliases).select(*SESSION, "project", "cwd", "session_timestamp")
    files = corpus.files.filter(provider_in_scope(o.provider)).join(ctx, SESSION)
    if o.one_project:
        files = files.filter(F.col("project") == o.one_project)
    if o.repo_path:
        files = files.filter(repo_scope(F.col("cwd"), F.col("project"), o.repo_path, o.aliases))
    return files


def audit_messages(corpus: Corpus, o: AuditOptions = AuditOptions()) -> DataFrame:
    """Prompts in range and the responses up to the next prompt, with ``prompt_no`` inside the session.

    Automation does not end an interaction.  Records without a line come last.
    """
    files = _audit_files(corpus, o).select(*SESSION).distinct()
    m = corpus.messages.join(files, SESSION, "left_semi").withColumns({
        "_line": F.coalesce("line", F.lit(1 << 53)), "_ts": F.coalesce("timestamp", F.lit(""))})
    order = ["_line", "_ts", "source_event", "seq"]
    prompt = is_submitted()
    wanted = prompt & in_range(F.col("timestamp"), o.since, o.until)
    numbered = running_sum(m, SESSION, order, {"boundary_no": prompt.cast("int"), "prompt_no": wanted.cast("int")})
    answer = (F.col("role") == "assistant") & F.col("content").rlike(f"[^{WS[1:]}")
    parts = numbered.filter(wanted | answer) if o.include_responses else numbered.filter(wanted)
    parts = parts.withColumn("kind", F.when(prompt, "prompt").otherwise("response"))
    # An interaction opened by a prompt outside the range shares the number of the prompt before it: drop its answers.
    opened = parts.filter(prompt).select(*SESSION, "boundary_no", F.col("prompt_no").alias("_open"))
    return (parts.join(opened, [*SESSION, "boundary_no"]).filter(F.col("_open") == F.col("prompt_no"))
            .select(*SESSION, "boundary_no", "prompt_no", "kind", "_line", "_ts", "seq", "turn_id", "timestamp",
                    "source_event", "content"))


def audit_responses(corpus: Corpus, o: AuditOptions = AuditOptions()) -> DataFrame:
    """Responses per prompt: how many, the first and the last time."""
    parts = audit_messages(corpus, o)
    k = F.col("kind")
    return parts.groupBy(*SESSION, "prompt_no").agg(
        F.min(F.when(k == "prompt", F.col("_line"))).alias("line"),
        F.count_if(k == "response").alias("responses"),
        F.min(F.when(k == "response", F.col("timestamp"))).alias("first_response"),
        F.max(F.when(k == "response", F.col("timestamp"))).alias("last_response"))


def audit_sections(corpus: Corpus, o: AuditOptions = AuditOptions(), parts: DataFrame | None = None) -> DataFrame:
    """One row per session with prompts: marker, header fields and counts.

    ``parts`` is an :func:`audit_messages` result to use again.
    """
    parts = stage_table(audit_messages(corpus, o)) if parts is None else parts
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    k = F.col("kind")
    facts = parts.groupBy(*SESSION).agg(F.min(ts).alias("f"), F.max(ts).alias("l"),
                                        F.count_if(k == "prompt").alias("prompts"),
                                        F.count_if(k == "response").alias("responses"))
    used = parts.filter(F.col("turn_id") != "").select(*SESSION, "turn_id").distinct()
    models = corpus.turns.filter(F.col("model") != "").join(used, [*SESSION, "turn_id"], "left_semi")
    models = models.select(*SESSION, "model").distinct().groupBy(*SESSION).agg(
        F.array_sort(F.collect_list("model")).alias("models"))
    out = _audit_files(corpus, o).join(facts, SESSION).join(models, SESSION, "left")
    start = F.nullif(F.col("session_timestamp"), F.lit(""))
    out = out.withColumns({"first_seen": F.least("f", start), "last_seen": F.greatest("l", start)})
    return out.select(
        session_marker(F.col("file_path"), F.col("session_id")).alias("marker"), *SESSION, "project", "cwd",
        day_key(F.coalesce("first_seen", "last_seen")).alias("date_label"),
        provider_label(F.col("source_label"), record_provider()).alias("provider_label"), "title",
        "provider_conversation_id", "first_seen", "last_seen",
        F.coalesce("models", F.array().cast("array<string>")).alias("models"), "prompts", "responses")


def _code(label: str, value, o: AuditOptions):
    return F.when(value != "", F.concat(F.lit(f"{label}: `"), o.inline(value), F.lit("`")))


def section_header(o: AuditOptions):
    """Markdown header of a section row."""
    c = F.col
    conversation = F.when(c("provider_conversation_id") != c("session_id"), c("provider_conversation_id"))
    models = F.array_join(F.transform("models", lambda x: F.concat(F.lit("`"), o.inline(x), F.lit("`"))), ", ")
    lines = F.array(
        F.concat(F.lit(f"<!-- {o.marker_tag} "), c("marker"), F.lit(" -->")),
        F.concat(F.lit("## "), c("date_label"), F.lit(" - "), c("project")), F.lit(""),
        F.concat(F.lit("Provider: `"), o.inline(c("provider_label")), F.lit("`")),
        _code("Title", c("title"), o), _code("Provider conversation", conversation, o),
        F.concat(F.lit("Session: `"), o.inline(c("session_id")), F.lit("`")),
        F.when(c("first_seen").isNotNull(), F.concat(F.lit("First seen: "), c("first_seen"))),
        F.when(c("last_seen").isNotNull(), F.concat(F.lit("Last seen: "), c("last_seen"))),
        _code("Working directory", c("cwd"), o),
        F.when(F.size("models") > 0, F.concat(F.lit("Models: "), models)), F.lit(""))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def audit_blocks(corpus: Corpus, o: AuditOptions = AuditOptions()) -> DataFrame:
    """Text blocks of the worklog with their order: sections by first seen, project and session."""
    parts = stage_table(audit_messages(corpus, o))
    sections = stage_table(audit_sections(corpus, o, parts))
    place = sections.select(*SESSION, "marker", F.coalesce("first_seen", F.lit("")).alias("section_seen"), "project")
    heads = sections.select(
        *SESSION, "marker", F.coalesce("first_seen", F.lit("")).alias("section_seen"), "project",
        F.lit(0).cast("bigint").alias("prompt_no"), F.lit(0).cast("bigint").alias("part_no"),
        F.lit("header").alias("kind"), section_header(o).alias("text"), F.lit(None).cast("string").alias("quote"))
    parts = running_sum(parts, [*SESSION, "prompt_no"], ["_line", "_ts", "source_event", "seq"],
                        {"response_no": (F.col("kind") == "response").cast("int")})
    per = parts.groupBy(*SESSION, "prompt_no").agg(F.count_if(F.col("kind") == "response").alias("n"))
    parts = parts.join(per, [*SESSION, "prompt_no"])
    quoted = blockquote(o.text(F.col("content")))
    stamp = F.when(F.col("timestamp") != "", F.concat(F.lit("Timestamp: "), F.col("timestamp"), F.lit("\n\n"))
                   ).otherwise("")
    silent = F.when((F.col("n") == 0) & F.lit(o.include_responses), F.lit(f"\n{NO_RESPONSE}\n")).otherwise("")
    title = F.when(F.col("kind") == "prompt", F.concat(F.lit("### User Message "), F.col("prompt_no").cast("string"))
                   ).when(F.col("n") == 1, "#### AI Response").otherwise(
        F.concat(F.lit("#### AI Response "), F.col("response_no").cast("string")))
    tail = F.when(F.col("kind") == "prompt", silent).otherwise("")
    body = parts.join(place, SESSION).select(
        *SESSION, "marker", "section_seen", "project", "prompt_no", F.col("response_no").alias("part_no"), "kind",
        F.concat(title, F.lit("\n\n"), stamp, quoted, F.lit("\n"), tail).alias("text"),
        F.when(F.col("kind") == "prompt", quote_key(quoted)).alias("quote"))
    return heads.unionByName(body)


BLOCK_ORDER = ["section_seen", "project", "session_id", "file_path", "prompt_no", "part_no"]


def audit_header(corpus: Corpus, o: AuditOptions = AuditOptions()) -> DataFrame:
    """The worklog's opening: one row with its totals as text."""
    s = stage_table(audit_sections(corpus, o).select("provider_label", "prompts", "responses"))
    label = o.project or (o.repo_path.rstrip("/").rsplit("/", 1)[-1] if o.repo_path else "All Projects")
    labels = s.select("provider_label").distinct().agg(
        F.array_join(F.array_sort(F.collect_list("provider_label")), ", ").alias("p")).scalar()
    facts = s.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("prompts"), F.lit(0)).alias("user_messages"),
                  F.coalesce(F.sum("responses"), F.lit(0)).alias("responses"))
    lines = [
        F.lit(f"# {o.title}"), F.lit(""),
        F.lit("Sanitized audit trail of AI-assisted work reconstructed from local AI system logs."), F.lit(""),
        F.lit(f"Generated: {o.generated_at}"), F.lit(f"Project filter: {label}"),
        F.lit(f"Provider filter: {o.provider or 'all'}"),
        F.concat(F.lit("Providers: "), F.coalesce(F.nullif("providers", F.lit("")), F.lit("none"))),
        F.lit(f"Privacy mode: {'raw' if o.raw else 'public'}"),
        F.concat(F.lit("Sessions: "), F.col("sessions").cast("string")),
        F.concat(F.lit("User messages: "), F.col("user_messages").cast("string")),
        F.concat(F.lit("AI responses: "), F.col("responses").cast("string")) if o.include_responses
        else F.lit("AI responses: not included"), F.lit(""),
        F.lit("> Review this file before committing it. Public mode preserves user intent while redacting obvious "
              "local home paths and contact or secret-like strings."), F.lit(""),
        F.when(F.col("sessions") == 0, F.lit("No matching submitted user messages were found.\n")),
    ]
    named = facts.withColumn("providers", labels)
    return named.select("sessions", "user_messages", "responses", "providers", F.array_join(
        F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n").alias("text"))


def write_audit(corpus: Corpus, path: str, o: AuditOptions = AuditOptions()) -> None:
    """Write the worklog as ordered text parts: file names sort in worklog order, the header comes first."""
    first = audit_header(corpus, o).select(
        *[F.lit("").alias(c) for c in BLOCK_ORDER[:4]], F.lit(-1).cast("bigint").alias("prompt_no"),
        F.lit(0).cast("bigint").alias("part_no"), "text")
    blocks = first.unionByName(audit_blocks(corpus, o).select(*BLOCK_ORDER, "text"))
    (blocks.repartitionByRange(*BLOCK_ORDER).sortWithinPartitions(*BLOCK_ORDER).select("text")
     .write.mode("overwrite").text(path))


@dataclass(frozen=True)
class ExistingAudit:
    markers: DataFrame
    session_ids: DataFrame
    quotes: DataFrame


def read_audit(lines: DataFrame, marker_tag: str = MARKER_TAG) -> ExistingAudit:
    """Markers, session ids and quote blocks of existing worklogs, given as ``(file_path, chunk, line, value)``."""
    v = F.col("value")
    marker = F.regexp_extract(v, rf"\A<!-- {marker_tag} ([a-f0-9]+) -->\z", 1)
    session = F.regexp_extract(v, r"\ASession: `([^`]+)`\z", 1)
    # Lines of one quote share the number of other lines before them; a quote is one message, so it is one row.
    quoted = running_sum(lines, ["file_path"], ["line"], {"block": (~v.startswith(">")).cast("int")}, F.col("chunk"))
    quotes = quoted.filter(v.startswith(">")).groupBy("file_path", "block").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("q"))
    return ExistingAudit(
        lines.select(marker.alias("marker")).filter("marker <> ''").distinct(),
        lines.select(session.alias("session_id")).filter("session_id <> ''").distinct(),
        quotes.select(quote_key(F.col("q")).alias("quote")).filter("quote <> ''").distinct())


def merge_audit(existing: ExistingAudit, corpus: Corpus, o: AuditOptions = AuditOptions()) -> tuple[DataFrame, DataFrame]:
    """New blocks to append, and one row of counts.

    A generated section is skipped when its marker or session id is known, or all its prompts are quoted already.
    """
    blocks = stage_table(audit_blocks(corpus, o))
    sections = blocks.filter(F.col("kind") == "header").select("marker", o.inline(F.col("session_id")).alias("sid"))
    known = existing.quotes.withColumn("known", F.lit(True))
    covered = (blocks.filter(F.col("quote") != "").join(known, "quote", "left").groupBy("marker")
               .agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known")).filter("all_known"))
    fresh = (sections.join(existing.markers, "marker", "left_anti")
             .join(existing.session_ids.withColumnRenamed("session_id", "sid"), "sid", "left_anti")
             .join(covered, "marker", "left_anti").select("marker"))
    appended = blocks.join(fresh, "marker", "left_semi")
    old = existing.markers.agg(F.count(F.lit(1)).alias("n")).scalar()
    new = fresh.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = sections.agg(F.count(F.lit(1)).alias("generated_sections")).select(
        new.alias("appended_sections"), (F.col("generated_sections") - new).alias("skipped_sections"),
        old.alias("existing_sections"), "generated_sections")
    return appended, counts
