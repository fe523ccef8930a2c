"""One Spark query per operator over the test tables, named as in ``oracle.py``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.bounded import bounded_raw
from logloom.functions.content import content_to_text, is_submitted, submitted_prompt_text
from logloom.functions.intents import with_intent
from logloom.functions.jsonv import parse_line
from logloom.functions.project import ProjectAlias
from logloom.functions.text import eval_id, redact_text, sanitize_snippet, snippet
from logloom.functions.times import date_preset, in_range
from logloom.functions.usage import usage_struct, usage_struct_cursor
from logloom.operators import audit, evals, interactions, privacy, prompts, ranked_index, refresh, search, sessions, tokens
from logloom.operators.context import SESSION, attach_model, session_contexts, sessions_by_id
from logloom.operators.scans import carry_forward
from logloom.operators.scope import (Scope, automation_messages, hidden_category, last_days_of_data, repo_scope,
                                     scoped_corpus, visible_session, warnings_in_scope)
from logloom.plans import summary
from logloom.plans.adapters import corpus_from_sf, prompt_corpus, table_views
from logloom.schema import Corpus
from logloom.session import delete_at_exit, staging_dir
from logloom.sources.claude import normalize_claude
from logloom.sources.codex import normalize_codex
from logloom.sources.cursor import normalize_cursor_kv, normalize_cursor_markdown

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANGE = {"since": "2024-01-05", "until": "2024-01-20"}
ALIASES = (ProjectAlias("Tools", ("team-tools", "nothing")), ProjectAlias("Home A", ("proj-a",)),
           ProjectAlias("Late", ("/home/dev/",)))
HIDDEN = ["Git commands", "Plan approvals"]


def _on_corpus(name: str):
    def add(fn: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf: fn(corpus_from_sf(spark, sf))
        return fn
    return add


def _on_tables(name: str):
    def add(fn: Query):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            table_views(spark, sf)  # settings
            return fn(spark, sf)
        QUERIES[name] = run
        return fn
    return add


def _joined(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as text, for comparison."""
    return df.withColumns({n: F.array_join(n, "|") for n in names})


# ---- tokens, buckets, models

_on_corpus("token_totals")(lambda c: tokens.token_totals(c.token_usage))
_on_corpus("tokens_by_day")(lambda c: tokens.token_buckets(c.token_usage, "day"))
_on_corpus("tokens_by_hour")(lambda c: tokens.token_buckets(c.token_usage, "hour"))
_on_corpus("model_usage")(lambda c: tokens.model_usage(c.turns, c.token_usage))
_on_corpus("provider_usage")(lambda c: tokens.provider_usage(c.files, c.messages, c.token_usage))
_on_corpus("messages_by_day")(lambda c: tokens.message_buckets(c.messages, c.token_usage, "day"))
_on_corpus("messages_by_hour")(lambda c: tokens.message_buckets(c.messages, c.token_usage, "hour"))
_on_corpus("hour_of_day")(lambda c: tokens.hour_of_day(tokens.message_buckets(c.messages, c.token_usage, "hour")))
_on_corpus("hour_of_day_output")(lambda c: tokens.hour_of_day(
    tokens.message_buckets(c.messages, c.token_usage, "hour"), "output_tokens"))
_on_corpus("hour_of_day_tokens")(lambda c: tokens.hour_of_day_tokens(
    tokens.message_buckets(c.messages, c.token_usage, "hour")))
_on_corpus("weekday")(lambda c: tokens.weekday_messages(tokens.message_buckets(c.messages, c.token_usage, "day")))


@_on_corpus("dedupe_token_events")
def _dedupe(c: Corpus) -> DataFrame:
    return tokens.dedupe_token_events(c.token_usage).select(
        *SESSION, "line", F.col("usage.fresh_input_tokens").alias("fresh_input_tokens"),
        F.col("usage.total_tokens").alias("total_tokens"))


@_on_corpus("turn_model_of_messages")
def _turn_model(c: Corpus) -> DataFrame:
    return attach_model(c.messages, c.turns).select(*SESSION, "line", "turn_id", "model")


# ---- summary, sessions, projects

_on_corpus("summary_totals")(lambda c: summary.summary_totals(c))
_on_corpus("summary_totals_scoped")(lambda c: summary.summary_totals(c, Scope(provider="codex", **RANGE)))
_on_corpus("session_days")(lambda c: _joined(sessions.session_days(c), "models"))
_on_corpus("activity_range")(lambda c: sessions.activity_range(sessions.session_days(c)))
_on_corpus("list_projects")(lambda c: _joined(sessions.list_projects(c), "providers", "cwd_samples"))
_on_corpus("projects_total")(lambda c: sessions.all_projects_total(sessions.list_projects(c)))
_on_corpus("session_spans")(lambda c: sessions.session_spans(c))
_on_corpus("corpus_fingerprint")(lambda c: sessions.corpus_fingerprint(c))
_on_corpus("sessions_by_id")(lambda c: sessions_by_id(c.sessions).select("session_id", "file_path", "timestamp", "cwd"))
_on_corpus("project_name")(lambda c: session_contexts(c).select(*SESSION, "cwd", "project"))
_on_corpus("alias_match")(lambda c: session_contexts(c, ALIASES).select(*SESSION, "cwd", "project"))


@_on_corpus("metrics_long")
def _metrics(c: Corpus) -> DataFrame:
    return summary.metrics_long(summary.summarize(c)).select("metric", "value")


@_on_corpus("redact_summary")
def _redacted(c: Corpus) -> DataFrame:
    parts = summary.redact_summary({"sessions": sessions.session_days(c)})
    return parts["sessions"].select("session_id", "date_key", "title", "provider_conversation_id", "file_path", "cwd",
                                    "user_messages")


@_on_corpus("report_parity")
def _parity(c: Corpus) -> DataFrame:
    def long(df: DataFrame) -> DataFrame:
        return df.select(F.concat(F.lit("tokens_by_day."), "bucket").alias("metric"),
                         F.col("total_tokens").cast("double").alias("value"))

    raw = c.token_usage.groupBy(F.substring("timestamp", 1, 10).alias("bucket")).agg(
        F.sum("usage.total_tokens").alias("total_tokens"))
    return summary.report_parity(long(tokens.token_buckets(c.token_usage, "day")), long(raw), 0.09)


# ---- filters

@_on_corpus("date_range")
def _date_range(c: Corpus) -> DataFrame:
    return c.messages.filter(in_range(F.col("timestamp"), **RANGE)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@_on_corpus("date_preset")
def _preset(c: Corpus) -> DataFrame:
    out = None
    for mode in ("all", "day", "week", "month", "year", "custom"):
        since, until = date_preset(mode, date(2024, 1, 17), date(2024, 1, 24), date(2024, 1, 9), date(2024, 1, 3))
        part = c.messages.filter(in_range(F.col("timestamp"), since, until)).agg(
            F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@_on_corpus("last_n_days")
def _last_days(c: Corpus) -> DataFrame:
    return last_days_of_data(c.messages, 7).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@_on_corpus("warnings_in_scope")
def _warned(c: Corpus) -> DataFrame:
    return warnings_in_scope(c, Scope(**RANGE)).select("file_path", "line", "code")


@_on_corpus("project_scope")
def _project_scope(c: Corpus) -> DataFrame:
    scoped = scoped_corpus(c, Scope(project="proj-a")).tables()
    out = None
    for name in ("files", "messages", "turns", "token_usage", "tool_events", "unknown_events", "warnings"):
        part = scoped[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@_on_corpus("repo_scope")
def _repo(c: Corpus) -> DataFrame:
    ctx = session_contexts(c)
    hit = repo_scope(F.col("cwd"), F.col("project"), "/work/other/proj-b") \
        | repo_scope(F.col("cwd"), F.col("project"), "/srv/checkout/team-tools/")
    return ctx.filter(hit).select(*SESSION)


@_on_corpus("visible_session")
def _visible(c: Corpus) -> DataFrame:
    return visible_session(c, "sx7", date_key="2024-01-02", scope=Scope(project="proj-z", **{"since": "2024-01-01"})
                           ).select(*SESSION, "line_count")


@_on_corpus("session_detail")
def _detail(c: Corpus) -> DataFrame:
    return summary.session_detail(c, "s3")["messages"].select(*SESSION, "line", "role", "category", "intent_key",
                                                             "intent_label")


_on_corpus("automation_messages")(lambda c: automation_messages(c.messages).select(*SESSION, "line", "timestamp"))


@_on_corpus("hidden_category")
def _hidden(c: Corpus) -> DataFrame:
    rows = search.with_category(c.messages).filter(hidden_category(F.col("category"), HIDDEN, ["Code review/QA"]))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# ---- prompts and intents

@_on_tables("intent_classify")
def _classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_intent(prompt_corpus(spark, sf).messages.repartition("line"))
    return _joined(rows, "signals").select("line", "rule_key", "rule_label", "intent_key", "intent_label",
                                           "confidence", "signals")


@_on_tables("repeated_documents")
def _repeated_documents(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.repeated_groups(prompt_corpus(spark, sf).messages.repartition("line")).select(
        "id", "category", "count", "session_count", "first_seen", "last_seen")


_on_corpus("repeated_prompts")(lambda c: prompts.repeated_prompts(c.messages).drop("group_key"))
_on_corpus("repeated_variants")(lambda c: prompts.repeated_variants(c.messages).drop("group_key"))
_on_corpus("repeated_projects")(lambda c: prompts.repeated_projects(c).drop("group_key"))
_on_corpus("repeated_categories")(lambda c: prompts.repeated_category_counts(prompts.repeated_groups(c.messages)))
_on_corpus("intent_summary")(lambda c: _joined(prompts.intent_summary(c), "examples"))
_on_corpus("intent_summary_visible")(lambda c: prompts.intent_summary_visible(prompts.intent_summary(c), HIDDEN).select(
    "intent_key", "count", "percentage"))
_on_corpus("intent_totals")(lambda c: prompts.intent_totals(prompts.intent_summary(c)))
_on_corpus("intent_projects")(lambda c: prompts.intent_projects(c))
_on_corpus("top_intents")(lambda c: prompts.top_intents(prompts.intent_summary(c)).select("intent_key", "count"))

# ---- search

PAGE = search.SearchOptions(query=" the   ", limit=20, offset=5)
FILTERS = search.SearchOptions(provider="codex", role="user", submitted_only=True, hidden_categories=HIDDEN,
                               project="proj-a", limit=50, **RANGE)


def _page(df: DataFrame) -> DataFrame:
    return df.drop("content", "source_label", "title", "provider_conversation_id")


_on_corpus("search_page")(lambda c: _page(search.search_page(c, PAGE)))
_on_corpus("search_count")(lambda c: search.search_count(c, PAGE))
_on_corpus("search_filters")(lambda c: _page(search.search_page(c, FILTERS)))
_on_corpus("search_model")(lambda c: search.search_matches(c, search.SearchOptions(model="unknown", query="an")).select(
    *SESSION, "line"))
_on_corpus("message_index")(lambda c: search.message_index(c).drop("ts", "content", "source_label", "title"))


def _indexed(options: search.SearchOptions) -> Query:
    """The index written to the staging folder, then searched there."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{staging_dir(spark)}/index-{uuid.uuid4().hex}"
        search.write_message_index(corpus_from_sf(spark, sf), path)
        delete_at_exit(spark, path)
        return search.search_index(spark.read.parquet(path), options).drop("content")
    return run


def _ranked(options: search.SearchOptions) -> Query:
    """The rank-ordered index written to the staging folder, then one page of it."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{staging_dir(spark)}/ranked-{uuid.uuid4().hex}"
        fingerprint = ranked_index.write_ranked_index(corpus_from_sf(spark, sf), path, part_rows=4096)
        delete_at_exit(spark, path)
        return _page(ranked_index.ranked_page(ranked_index.open_ranked_index(spark, path, fingerprint), options)).drop("seq")
    return run


DEEP = search.SearchOptions(provider="codex", limit=500, offset=200)
QUERIES["search_page_ranked"] = _ranked(PAGE)
QUERIES["search_filters_ranked"] = _ranked(FILTERS)
QUERIES["browse_page_ranked"] = _ranked(DEEP)
QUERIES["search_page_index"] = _indexed(PAGE)
QUERIES["search_filters_index"] = _indexed(FILTERS)
_on_corpus("demo_search")(lambda c: search.demo_search(
    search.message_index(c).withColumn("snippet", snippet(F.col("content"), "PROJ-A")), "PROJ-A", "user").select(
    *SESSION, "line"))


# ---- interactions

@_on_corpus("carry_forward")
def _carry(c: Corpus) -> DataFrame:
    return carry_forward(c.messages, ["file_path"], ["line", "seq"], {
        "last_prompt": F.when(is_submitted(), F.col("line"))}).select("file_path", "line", "last_prompt")


_on_corpus("prompt_ordinals")(lambda c: interactions.prompt_ordinals(c.messages).select(*SESSION, "line", "prompt_no"))
_on_corpus("interaction_records")(lambda c: interactions.interaction_records(c).select(
    *SESSION, "line", "seq", "kind", "prompt_line"))
_on_corpus("hit_to_prompt")(lambda c: interactions.hit_to_prompt(c))


@_on_corpus("interactions")
def _interactions(c: Corpus) -> DataFrame:
    return interactions.interactions(c).withColumn("total_tokens", F.col("usage.total_tokens")).drop("usage")


@_on_corpus("turn_interactions")
def _turn_interactions(c: Corpus) -> DataFrame:
    return interactions.turn_interactions(c).withColumn("total_tokens", F.col("usage.total_tokens")).drop("usage")


# ---- audit

AUDIT = audit.AuditOptions(**RANGE)
_on_corpus("audit_responses")(lambda c: audit.audit_responses(c, AUDIT))
_on_corpus("audit_sections")(lambda c: _joined(audit.audit_sections(c, AUDIT), "models"))
_on_corpus("audit_blocks")(lambda c: audit.audit_blocks(c, audit.AuditOptions(raw=True)).filter("kind <> 'header'").select(
    *SESSION, "marker", "prompt_no", "part_no", "kind", "text"))
_on_corpus("audit_header")(lambda c: audit.audit_header(c, AUDIT).drop("text"))


@_on_corpus("audit_merge")
def _merge(c: Corpus) -> DataFrame:
    number = F.regexp_extract("file_path", r"(\d+)", 1).cast("int")
    old = c.messages.filter(is_submitted()).withColumn("n", number % 4)
    marker = F.sha2(F.concat_ws("\n", *SESSION).cast("binary"), 256)
    text = (F.when(F.col("n") == 0, F.array(F.concat(F.lit("Session: `"), "session_id", F.lit("`"))))
            .when(F.col("n") == 1, F.array(F.concat(F.lit(f"<!-- {audit.MARKER_TAG} "), F.substring(marker, 1, 16),
                                                    F.lit(" -->"))))
            .when(F.col("n") == 2, F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("> "), x))))
    lines = old.select("file_path", "line", F.posexplode(F.concat(text, F.array(F.lit(""))))).select(
        "file_path", F.lit(0).alias("chunk"), (F.col("line") * 1000000 + F.col("pos")).alias("line"),
        F.col("col").alias("value"))
    return audit.merge_audit(audit.read_audit(lines), c, audit.AuditOptions(raw=True))[1]


@_on_tables("redact_text")
def _redact(spark: SparkSession, sf: str) -> DataFrame:
    rows = prompt_corpus(spark, sf).messages.repartition("line").withColumn("r", redact_text(F.col("content")))
    return rows.filter(F.col("r") != F.col("content")).select("line", F.length("r").alias("n"),
                                                                F.md5(F.col("r").cast("binary")).alias("digest"))


@_on_corpus("sanitize_snippet")
def _sanitize(c: Corpus) -> DataFrame:
    return c.messages.select(*SESSION, "line", sanitize_snippet(F.col("content")).alias("text"))


# ---- evaluation

def _reviews(c: Corpus) -> DataFrame:
    rows = c.messages.filter("source_event = 'event_msg.user_message' AND length(content) % 3 <> 0")
    expected = F.element_at(F.array(*[F.lit(k) for k in ("git-commands", "feedback-context", "bug-fixes", "research")]),
                            (F.length("content") % 4 + 1).cast("int"))
    return rows.select(eval_id(*[F.col(x) for x in (*SESSION, "line", "turn_id", "timestamp", "content")]).alias("eval_id"),
                       F.lit("other").alias("actual_key"), expected.alias("expected_key"), F.lit(False).alias("is_correct"),
                       F.col("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("note"))


def _eval_rows(c: Corpus, o: evals.EvalOptions = evals.EvalOptions()) -> DataFrame:
    return evals.eval_messages(c, _reviews(c), o)


_on_corpus("eval_messages")(lambda c: _joined(_eval_rows(c), "signals").drop("content", "note", "rule_label"))
_on_corpus("eval_page")(lambda c: evals.eval_page(
    _eval_rows(c, evals.EvalOptions(query="the", **RANGE)), evals.EvalOptions(review_state="incorrect", limit=7, offset=2)
).select("eval_id", "line", "intent_key", "expected_key", "rank"))
_on_corpus("eval_summary")(lambda c: evals.eval_summary(_eval_rows(c)))
_on_corpus("eval_totals")(lambda c: evals.eval_totals(_eval_rows(c)))
_on_corpus("eval_confusions")(lambda c: evals.eval_confusions(_eval_rows(c)))
_on_corpus("eval_report")(lambda c: evals.eval_report(_eval_rows(c, evals.EvalOptions(**RANGE)), _reviews(c)))
_on_corpus("eval_report_categories")(lambda c: evals.eval_report_categories(_eval_rows(c)))
_on_corpus("fixture_draft")(lambda c: evals.fixture_draft(_eval_rows(c)))
_on_corpus("draft_totals")(lambda c: evals.draft_totals(evals.fixture_draft(_eval_rows(c))))


@_on_corpus("review_upsert")
def _upsert(c: Corpus) -> DataFrame:
    stored = _reviews(c)
    changes = stored.filter("substring(eval_id, 1, 1) < '8'").withColumns({
        "actual_key": F.lit("research"), "note": F.lit("changed")})
    gone = stored.filter("substring(eval_id, 1, 1) = 'f'")
    return evals.delete_reviews(evals.upsert_reviews(stored, changes), gone).select(
        "eval_id", "actual_key", "expected_key", "is_correct", "note")


def _gold(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(evals.classify_gold(table_views(spark, sf)["lg_gold"].repartition("id")))


QUERIES["classifier_check"] = _gold(evals.classifier_categories)
QUERIES["classifier_totals"] = _gold(lambda g: evals.classifier_totals(g, 0.5))
QUERIES["classifier_counts"] = _gold(evals.classifier_counts)
QUERIES["classifier_changes"] = _gold(evals.classifier_changes)
QUERIES["classifier_mismatches"] = _gold(lambda g: _joined(evals.classifier_mismatches(g), "signals"))


# ---- privacy

def _documents(spark: SparkSession, sf: str) -> DataFrame:
    table_views(spark, sf)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").repartition("doc_id")


@_on_tables("secret_scan")
def _secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.secret_scan(_documents(spark, sf), ["doc_id"], "text")


@_on_tables("repository_scan")
def _repository_scan(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.secret_scan(_documents(spark, sf), ["doc_id"], "text", privacy.REPOSITORY_RULES)


@_on_tables("secret_report")
def _secret_report(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.secret_report(privacy.secret_scan(_documents(spark, sf), ["doc_id", "source"], "text"), "source")


@_on_tables("path_scan")
def _path_scan(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    ending = F.element_at(F.array(*[F.lit(x) for x in ("/a.PNG", "/dist/x.js", "/.env", "/k.pem", "/src/a.ts")]),
                          (F.col("page_id") % 5 + 1).cast("int"))
    return privacy.path_scan(pages.select(F.concat("url", ending).alias("file_path")))


@_on_corpus("path_rewrite")
def _rewrite(c: Corpus) -> DataFrame:
    moved = privacy.path_rewrite(c, "/home/dev", "/generated")
    return moved.sessions.select(*SESSION, "line", "cwd")


# ---- normalization: records are rebuilt as raw input, then parsed

def _line_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table_views(spark, sf)["lg_conv"]


def _record(kind: str, payload: dict) -> F.Column:
    return F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit(kind).alias("type"),
                              F.struct(*[v.alias(k) for k, v in payload.items()]).alias("payload")))


def _rollout(spark: SparkSession, sf: str) -> Corpus:
    """Four lines per conversation row: session, turn context, message, and tokens, tool or unknown record."""
    c, turn = F.col("conv_id"), F.col("turn")
    own = F.concat(F.when((c % 8 == 7) & (turn >= 4), "sx").otherwise("s"), c.cast("string"))
    meta = F.when((turn == 0) | ((turn == 4) & (c % 8 == 7)), _record("session_meta", {
        "id": own, "cwd": F.concat(F.lit("/w/p"), (c % 5).cast("string"))})).otherwise("")
    ctx = F.when(turn % 2 == 0, _record("turn_context", {
        "turn_id": F.concat(F.lit("t"), F.col("turn_no").cast("string")), "model": F.concat(F.lit("m"), (c % 3).cast("string"))}
    )).otherwise("{bad")
    said = (F.when(F.col("role") == "user", _record("event_msg", {"type": F.lit("user_message"), "message": F.col("text")}))
            .when(F.col("role") == "assistant", _record("event_msg", {
                "type": F.lit("agent_message"), "message": F.col("text"), "phase": F.lit("final")}))
            .otherwise(_record("response_item", {
                "type": F.lit("message"), "role": F.lit("system"), "content": F.array(
                    F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text")))})))
    usage = F.struct(F.length("text").alias("input_tokens"), F.lit(3).alias("cached_input_tokens"),
                     turn.alias("output_tokens"))
    tail = (F.when(F.col("role") == "assistant", _record("event_msg", {
                "type": F.lit("token_count"), "info": F.struct(usage.alias("last_token_usage"))}))
            .when(F.col("role") == "user", _record("event_msg", {
                "type": F.lit("exec_command_end"), "exit_code": turn, "duration": F.struct(F.lit(1.5).alias("millis"))}))
            .otherwise(_record("mystery", {"type": F.lit("odd"), "n": c})))
    done = F.when(F.col("role") == "assistant", _record("event_msg", {
        "type": F.lit("task_complete"), "duration_ms": turn * 10})).otherwise(
        _record("event_msg", {"type": F.lit("task_started"), "started_at": turn}))
    rows = _line_rows(spark, sf).select(
        F.concat(F.lit("/r/rollout-c"), c.cast("string"), F.lit(".jsonl")).alias("file_path"), turn.alias("chunk"), turn,
        F.posexplode(F.array(meta, ctx, said, tail, done)))
    return normalize_codex(rows.select("file_path", "chunk", (turn * 5 + F.col("pos") + 1).alias("line"),
                                       F.col("col").alias("value")))


QUERIES["normalize_codex_messages"] = lambda s, sf: _rollout(s, sf).messages.select(
    *SESSION, "line", "turn_id", "role", "source_event", "content", "phase")
QUERIES["normalize_codex_tokens"] = lambda s, sf: _rollout(s, sf).token_usage.select(*SESSION, "line", "turn_id", "usage.*")
QUERIES["normalize_codex_tools"] = lambda s, sf: _rollout(s, sf).tool_events.select(
    *SESSION, "line", "turn_id", "event_type", "exit_code", "duration_ms")
QUERIES["normalize_codex_turns"] = lambda s, sf: _rollout(s, sf).turns.select(*SESSION, "line", "turn_id", "model", "cwd")
QUERIES["normalize_codex_unknown"] = lambda s, sf: _rollout(s, sf).unknown_events.select(
    *SESSION, "line", "top_level_type", "payload_type", "raw")
QUERIES["normalize_codex_warnings"] = lambda s, sf: _rollout(s, sf).warnings.select("file_path", "line", "code")
QUERIES["normalize_codex_files"] = lambda s, sf: _rollout(s, sf).files.select(*SESSION, "line_count")
QUERIES["session_rows"] = lambda s, sf: _rollout(s, sf).sessions.select(*SESSION, "line", "cwd")
QUERIES["task_timings"] = lambda s, sf: _rollout(s, sf).task_timings.select(*SESSION, "turn_id", "duration_ms")


def _claude(spark: SparkSession, sf: str) -> Corpus:
    c, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"),
                 F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<n:bigint>").alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("call").alias("id"),
                 F.lit("Read").alias("name"), F.struct(turn.alias("n")).alias("input")))
    usage = F.when(role == "assistant", F.struct(turn.alias("input_tokens"), F.lit(2).alias("cache_creation_input_tokens"),
                                                 F.lit(3).alias("cache_read_input_tokens"), c.alias("output_tokens")))
    message = F.struct(role.alias("role"), F.when(role == "assistant", F.concat(F.lit("m"), (c % 3).cast("string"))
                                                  ).alias("model"), blocks.alias("content"), usage.alias("usage"))
    line = F.when(F.col("turn") == 5, F.to_json(F.struct(F.lit("summary").alias("type"), F.concat(
        F.lit("Title "), c.cast("string")).alias("summary")))).otherwise(F.to_json(F.struct(
            role.alias("type"), F.concat(F.lit("s"), c.cast("string")).alias("sessionId"),
            F.concat(F.lit("u"), turn.cast("string")).alias("uuid"),
            F.when(turn == 1, "/w/lib").alias("cwd"), message.alias("message"))))
    rows = _line_rows(spark, sf).select(
        F.concat(F.lit("/k/c"), c.cast("string"), F.lit(".jsonl")).alias("file_path"), turn.alias("chunk"),
        (turn + 1).alias("line"), line.alias("value"))
    return normalize_claude(rows)


QUERIES["normalize_claude"] = lambda s, sf: _claude(s, sf).messages.select(
    *SESSION, "line", "turn_id", "role", "source_event", "content", "title")
QUERIES["normalize_claude_sessions"] = lambda s, sf: _claude(s, sf).sessions.select(
    *SESSION, "line", "cwd", "title", "provider_conversation_id")
QUERIES["normalize_claude_tools"] = lambda s, sf: _claude(s, sf).tool_events.select(
    *SESSION, "line", "seq", "event_type", "name", "call_id", "content")
QUERIES["normalize_claude_tokens"] = lambda s, sf: _claude(s, sf).token_usage.select(*SESSION, "line", "usage.*")


def _kv(spark: SparkSession, sf: str) -> Corpus:
    c, turn = F.col("conv_id"), F.col("turn")
    tool = F.array(F.struct(F.lit("Run").alias("name"), F.concat(F.lit(" out "), turn.cast("string")).alias("output")))
    value = F.to_json(F.struct(
        F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(7).alias("type"),
        F.col("text").alias("text"), ((F.lit(1704067200) + F.lit(1000) - turn) * 1).alias("createdAt"),
        F.when(F.col("role") == "assistant", F.struct(turn.alias("inputTokens"), F.lit(4).alias("outputTokens"))
               ).alias("tokenCount"),
        F.when(F.col("role") == "assistant", turn * 2).alias("turnDurationMs"),
        F.when(turn == 1, tool).alias("toolResults")))
    rows = _line_rows(spark, sf).select(
        F.lit("/u/globalStorage/state.vscdb").alias("file_path"), F.lit("bubble").alias("source"),
        (c * 100 + turn + 1).alias("row_number"),
        F.concat(F.lit("bubbleId:k"), c.cast("string"), F.lit(":b"), turn.cast("string")).alias("key"),
        F.when(turn == 6, "{oops").otherwise(value).alias("value"), F.lit(None).cast("string").alias("code"),
        F.lit(None).cast("string").alias("note"))
    return normalize_cursor_kv(rows)


QUERIES["normalize_cursor_kv"] = lambda s, sf: _kv(s, sf).messages.select(
    "session_id", "line", "turn_id", "timestamp", "role", "source_event", "content")
QUERIES["normalize_cursor_kv_facts"] = lambda s, sf: _kv(s, sf).token_usage.select(
    "session_id", "line", F.col("usage.total_tokens").alias("total_tokens")).join(
    _kv(s, sf).tool_events.select("session_id", "line", "name", "call_id", "content"), ["session_id", "line"], "full_outer")
QUERIES["normalize_cursor_kv_warnings"] = lambda s, sf: _kv(s, sf).warnings.select("line", "code", "message")


def _markdown(spark: SparkSession, sf: str) -> Corpus:
    c, turn = F.col("conv_id"), F.col("turn")
    head = F.when(F.col("role") == "user", F.lit("## User")).when(F.col("role") == "assistant", "**AI**:").otherwise("# T")
    rows = _line_rows(spark, sf).select(
        F.concat(F.lit("/m/c"), c.cast("string"), F.lit(".md")).alias("file_path"), turn.alias("chunk"), turn,
        F.posexplode(F.concat(F.array(head), F.split("text", r"\r?\n"))))
    return normalize_cursor_markdown(rows.select(
        "file_path", "chunk", (turn * 1000000 + F.col("pos") + 1).alias("line"), F.col("col").alias("value")))


QUERIES["normalize_markdown"] = lambda s, sf: _markdown(s, sf).messages.filter("role = 'assistant'").select(
    *SESSION, "line", "role", "source_event", "content", "title")


@_on_tables("usage_struct")
def _usage(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.to_json(F.struct(
        F.floor("value").alias("input_tokens"), F.when(k % 2 == 0, k).alias("cached_input_tokens"),
        F.when(k % 3 == 0, k).alias("cache_creation_input_tokens"), F.when(k % 5 == 0, F.lit("7")).alias("output_tokens"),
        F.when(k % 7 == 0, F.lit(999)).alias("total_tokens")))
    return e.select("event_id", usage_struct(parse_line(text)).alias("u")).select("event_id", "u.*")


@_on_tables("usage_struct_cursor")
def _usage_cursor(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.to_json(F.struct(F.when(k % 2 == 0, k).alias("inputTokens"), F.when(k % 3 == 0, k).alias("output_tokens")))
    return e.select("event_id", usage_struct_cursor(parse_line(text)).alias("u")).filter("u IS NOT NULL").select(
        "event_id", "u.input_tokens", "u.output_tokens", "u.total_tokens")


@_on_tables("prompt_text")
def _prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    comment = F.concat(F.lit("# Diff comments:\n\n## Comment 1\nFile: a\nComment:\n"), F.col("text"),
                       F.lit("\n\n## Comment 2\nComment:\nsecond\n\n## My request for Codex:\n<image name=x></image>\n"))
    raw = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Files\nx\n## My request for Codex:\n"), "text", F.lit("\n<image>\n")))
           .when(F.col("doc_id") % 3 == 1, comment).otherwise(F.col("text")))
    out = submitted_prompt_text(raw)
    return d.select("doc_id", F.length(out).alias("n"), F.md5(out.cast("binary")).alias("digest"))


@_on_tables("content_to_text")
def _content(spark: SparkSession, sf: str) -> DataFrame:
    rows = _line_rows(spark, sf)
    none = F.lit(None).cast("string")
    inner = F.struct(F.lit("nested").alias("text"))
    block = F.array(F.struct(F.col("text").alias("text"), none.alias("output_text"), F.lit(None).cast("array<struct<text:string>>").alias("content")),
                    F.struct(none.alias("text"), F.col("role").alias("output_text"), F.lit(None).cast("array<struct<text:string>>").alias("content")),
                    F.struct(none.alias("text"), none.alias("output_text"), F.array(inner, inner).alias("content")))
    value = F.to_json(F.struct(block.alias("content")))
    return rows.select("conv_id", "turn", content_to_text(parse_line(value), "$.content").alias("text"))


@_on_tables("bounded_raw")
def _bounded(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf).withColumn("b", bounded_raw(F.to_json(F.struct("text", F.struct(
        F.col("doc_id").alias("n"), F.sequence(F.lit(1), F.lit(22)).alias("list")).alias("x")))))
    return d.select("doc_id", "b.raw", "b.raw_truncated")


# ---- refresh

def _manifests(spark: SparkSession, sf: str):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    path = F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    at = F.timestamp_seconds(F.lit(1704067200))
    old = d.filter("doc_id % 10 <> 0").select(path.alias("file_path"), F.col("n_chars").alias("size"), at.alias("modified"),
                                                F.when(F.col("doc_id") % 17 == 0, "0").otherwise("1").alias("parser_version"))
    new = d.filter("doc_id % 10 <> 1").select(path.alias("file_path"), (F.col("n_chars") + (F.col("doc_id") % 7 == 0).cast("int")
                                                                          ).alias("size"), at.alias("modified"))
    return old, new


@_on_tables("manifest_diff")
def _diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _manifests(spark, sf)
    return refresh.manifest_diff(old, new, refresh.in_scope(["/in/src1", "/in/src2", "/in/src11"])).select(
        "file_path", "action")


@_on_tables("refresh_counts")
def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.refresh_counts(refresh.manifest_diff(*_manifests(spark, sf)))
