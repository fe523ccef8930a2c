"""Summaries, audit, refresh, exports and streams on log files."""

import json
import os

from conftest import at, event, rows
from pyspark.sql import functions as F

from logloom import Scope, load_corpus, summarize
from logloom.operators import audit, evals, interactions, refresh, search
from logloom.plans import summary
from logloom.schema import USAGE_FIELDS
from logloom.sources.lines import read_lines
from logloom.streaming.live import live_token_buckets, refresh_stream


def log(sid, cwd, prompts, start=0, day="2026-01-01"):
    def when(n):
        return f"{day}T{(start + n) // 60:02d}:{(start + n) % 60:02d}:00.000Z"

    def ev(n, kind, **payload):
        return {"timestamp": when(n), "type": kind, "payload": payload}

    out = [ev(0, "session_meta", id=sid, timestamp=when(0), cwd=cwd)]
    for i, p in enumerate(prompts):
        n = 3 * i + 1
        usage = {"input_tokens": 10 + i, "cached_input_tokens": 4, "output_tokens": 2, "total_tokens": 12 + i}
        token = ev(n + 1, "event_msg", type="token_count", info={"last_token_usage": usage})
        out += [ev(n, "turn_context", turn_id=f"t{i}", model="m1" if i % 2 else "m2"),
                ev(n, "event_msg", type="user_message", message=p),
                ev(n + 1, "event_msg", type="agent_message", message=f"answer {i} token=abc"),
                ev(n + 1, "event_msg", type="exec_command_end"), token, token]
    return out


APPROVALS = ["yes", "Yes!", "ok", "go ahead", "sounds good", "please do", "yes", "proceed"]


def test_summary_facts(spark, write):
    root = os.path.dirname(write("a.jsonl", log("S1", "/w/app", APPROVALS + ["Explain  the cache"])))
    write("b.jsonl", log("S1", "/w/other", ["explain the CACHE"], day="2026-01-03"))
    c = load_corpus(spark, [root])
    parts = summarize(c)
    t = parts["totals"].collect()[0]
    assert (t.sessions, t.turns, t.user_messages, t.unique_user_messages, t.tool_events) == (2, 10, 10, 2, 10)
    k = parts["tokens"].collect()[0]
    assert k.total_tokens == sum(12 + i for i in range(9)) + 12 and k.fresh_input_tokens == sum(6 + i for i in range(9)) + 6
    assert sorted(rows(parts["repeated"], "sample", "count", "session_count")) == [
        ("Explain the cache", 2, 2), ("Plan approvals", 8, 1)]
    variants = parts["repeated_variants"].filter("group_key = 'category:plan-approvals'")
    assert sorted(rows(variants, "sample", "count"))[-1] == ("yes", 2) and variants.count() == 7
    assert sorted(rows(parts["models"], "model", "turns")) == [("m1", 4), ("m2", 6)]
    assert sorted(rows(parts["sessions"], "project", "date_key", "user_messages")) == [
        ("app", "2026-01-01", 9), ("other", "2026-01-03", 1)]
    late = summarize(c, Scope(project="other", since="2026-01-02"))
    assert late["totals"].collect()[0].user_messages == 1
    hidden = search.search_count(c, search.SearchOptions(submitted_only=True, hidden_categories=["Plan approvals"]))
    assert hidden.collect()[0].total_matches == 2
    page = search.search_page(c, search.SearchOptions(query="the cache", limit=1)).collect()
    assert page[0].snippet == "explain the CACHE" and page[0].id.endswith("#1") and page[0].model == "m2"


def test_exports(spark, write, tmp_path):
    c = load_corpus(spark, [write("a.jsonl", log("S1", "/w/app", ["yes", "yes"]))])
    parts = summarize(c)
    summary.write_summary_json(parts, str(tmp_path / "json"))
    sessions = spark.read.json(str(tmp_path / "json" / "sessions")).collect()[0]
    assert sessions.file_path == "[redacted]" and sessions.cwd == "[redacted]" and sessions.user_messages == 2
    summary.write_summary_csv(parts, str(tmp_path / "csv"))
    metrics = dict(rows(spark.read.option("header", True).csv(str(tmp_path / "csv"))))
    assert metrics["total_tokens"] == "25" and metrics["provider_codex_messages"] == "2"
    reference = summary.parity_metrics(parts)
    assert summary.report_parity(reference, reference).count() == 0
    off = reference.withColumn("value", F.col("value") + 5).unionByName(
        spark.createDataFrame([("models.none.turns", 1.0)], "metric string, value double"))
    bad = {r.metric: r for r in summary.report_parity(reference, off, 0.2).collect()}
    assert bad["models.none.turns"].actual is None and "totals.turns" in bad


def test_audit_round_trip(spark, write, tmp_path):
    root = os.path.dirname(write("a.jsonl", log("S1", "/Users/ana/app", ["Add x", "mail a@b.org"])))
    write("b.jsonl", log("S2", "/w/app", ["Add y"], start=600))
    write("c.jsonl", log("S3", "/w/app-two", ["Add z"]))
    c = load_corpus(spark, [root])
    assert sorted(rows(audit.audit_sections(c, audit.AuditOptions(repo_path="/w/app")), "session_id")) == [("S2",)]
    audit.write_audit(c, str(tmp_path / "log"), audit.AuditOptions(generated_at="now"))
    parts = sorted(p for p in os.listdir(tmp_path / "log") if p.startswith("part-"))
    text = "".join((tmp_path / "log" / p).read_text() for p in parts)
    assert text.index("Sessions: 3") < text.index("Session: `S1`") < text.index("Session: `S2`")
    assert "~/app" in text and "[redacted-email]" in text and "token=[redacted-secret]" in text
    assert text.index("### User Message 1") < text.index("> answer 0") < text.index("### User Message 2")
    existing = audit.read_audit(read_lines(spark, [str(tmp_path / "log")]))
    write("d.jsonl", log("S4", "/w/app", ["Add w"]))
    counts = audit.merge_audit(existing, load_corpus(spark, [root]))[1].collect()[0]
    assert tuple(counts) == (1, 3, 3, 4)
    quoted = write("old.txt", ["Session: `S1`", "", "> Add y", "x", "> Add", "> z", ""])
    fresh, counts = audit.merge_audit(audit.read_audit(read_lines(spark, [quoted])), c)
    assert counts.collect()[0].appended_sections == 1
    assert {r.session_id for r in fresh.collect()} == {"S3"}


def test_interactions_end_at_automation(spark, write):
    base = log("S1", "/w", ["one"])
    more = [event(100, "event_msg", type="user_message", message="automation: go"),
            event(101, "event_msg", type="agent_message", message="auto answer"),
            event(102, "event_msg", type="user_message", message="two"),
            event(103, "event_msg", type="agent_message", message="same"),
            event(104, "event_msg", type="agent_message", message=" same ")]
    c = load_corpus(spark, [write("a.jsonl", base + more)])
    got = sorted(rows(interactions.interactions(c), "prompt", "assistant_messages", "tool_events", "token_events", "last_response"))
    assert got == [("one", 1, 1, 2, "answer 0 token=abc"), ("two", 1, 0, 0, "same")]
    asked = {r.line: r.prompt_line for r in interactions.hit_to_prompt(c).collect()}
    assert asked[9] == 3 and asked[10] == 10
    assert rows(audit.audit_responses(c), "responses") == [(2,), (2,)]


def test_refresh(spark, write, tmp_path):
    cache = str(tmp_path / "cache")
    a = write("in/a.jsonl", log("S1", "/w/app", ["one"]))
    b = write("in/b.jsonl", log("S2", "/w/app", ["two"]))
    root = os.path.dirname(a)

    def run(**options):
        c, counts = refresh.refresh_corpus(spark, cache, [root], **options)
        return sorted(r.content for r in c.messages.filter("role = 'user'").collect()), tuple(counts.collect()[0])

    assert run() == (["one", "two"], (0, 2, 0, 2, "updated"))
    assert run() == (["one", "two"], (2, 0, 0, 2, "ready"))
    write("in/b.jsonl", log("S2", "/w/app", ["two", "three"]))
    assert run() == (["one", "three", "two"], (1, 1, 0, 2, "updated"))
    os.remove(a)
    assert run() == (["three", "two"], (1, 0, 1, 1, "updated"))
    assert run(rebuild=True) == (["three", "two"], (0, 1, 1, 1, "rebuilt"))
    assert os.path.exists(b)


def test_refresh_stream(spark, write, tmp_path):
    cache, check = str(tmp_path / "cache"), str(tmp_path / "check")
    root = os.path.dirname(write("in/a.jsonl", log("S1", "/w/app", ["one"])))
    refresh_stream(spark, root, cache, check).awaitTermination(120)
    write("in/b.jsonl", log("S2", "/w/app", ["two"]))
    refresh_stream(spark, root, cache, check).awaitTermination(120)
    assert sorted(r.content for r in refresh.read_cache(spark, cache).messages.filter("role = 'user'").collect()) == ["one", "two"]


def test_live_buckets_drop_repeats(spark, tmp_path):
    usage = ", ".join(f"cast({v} as bigint) as {n}" for n, v in zip(USAGE_FIELDS, (5, 0, 0, 0, 5, 1, 0, 6)))
    data = spark.sql(f"""SELECT 'f' AS file_path, s AS timestamp, 't' AS turn_id, cast(s AS timestamp) AS ts, struct({usage}) AS usage
        FROM VALUES ('2026-01-01T00:10:00Z'), ('2026-01-01T00:10:00Z'), ('2026-01-01T05:00:00Z'), ('2026-01-02T01:00:00Z'),
        ('2026-01-04T01:00:00Z') AS v(s)""")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    query = (live_token_buckets(stream).writeStream.outputMode("complete").format("memory").queryName("live")
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert sorted(rows(spark.table("live"), "bucket", "total_tokens")) == [
        ("2026-01-01", 12), ("2026-01-02", 6), ("2026-01-04", 6)]


def test_live_buckets_in_another_zone(spark, tmp_path):
    usage = ", ".join(f"cast(1 as bigint) as {n}" for n in USAGE_FIELDS)
    data = spark.sql(f"""SELECT 'f' AS file_path, 'x' AS timestamp, 't' AS turn_id, timestamp'2026-01-01T22:00:00Z' AS ts, struct({usage}) AS usage""")
    data.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
        (live_token_buckets(stream).writeStream.outputMode("complete").format("memory").queryName("live_zone")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()).awaitTermination(120)
        assert rows(spark.table("live_zone"), "bucket") == [("2026-01-02",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_last_days_ignore_unreadable_instants(spark):
    from logloom.operators.scope import last_days_of_data

    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-20T00:00:00Z",), ("n/a",), (None,)], "timestamp string")
    assert rows(last_days_of_data(df, 7)) == [("2026-01-20T00:00:00Z",)]


def test_classifier_gate(spark):
    gold = spark.createDataFrame([
        ("a", "deploy it", "deploy-release-run-build", None), ("b", "commit", "git-commands", "research"),
        ("c", "zebra stripes", "research", "research")], "id string, message string, expected_key string, previous_key string")
    got = evals.classify_gold(gold)
    assert tuple(evals.classifier_totals(got).collect()[0]) == (3, 2, 0.667, 1.0, False)
    assert sorted(rows(evals.classifier_changes(got), "id", "status")) == [("b", "expected-change"), ("c", "unexpected-change")]
    assert json.dumps(at(1))
