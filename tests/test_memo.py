"""The memo of distinct prompts."""

import os

import pytest
from conftest import event, rows
from test_jobs import APPROVALS, log

from logloom import load_corpus, summarize
from logloom.functions import intents
from logloom.operators import memo
from logloom.operators.prompts import intent_summary, repeated_groups
from logloom.operators.tokens import message_buckets
from logloom.plans.summary import summary_totals


@pytest.fixture
def corpus(spark, write):
    prompts = [*APPROVALS, "", "Explain  the cache", "fix the bug", "Fix the bug!", "deploy it", "why is it slow"]
    root = os.path.dirname(write("a.jsonl", log("S1", "/w/app", prompts)))
    write("b.jsonl", log("S2", "/w/other", ["explain the CACHE", "yes", "commit"], day="2026-01-03"))
    write("c.jsonl", [event(0, "session_meta", id="S3", cwd="/w/app"), event(1, "event_msg", type="user_message", message="automation: go")])
    return load_corpus(spark, [root])


def test_annotated_rows_give_the_direct_results(corpus):
    c = corpus
    parts = summarize(c)
    assert rows(parts["totals"]) == rows(summary_totals(c))
    assert sorted(rows(parts["messages_by_day"])) == sorted(rows(message_buckets(c.messages, c.token_usage)))
    assert sorted(map(str, rows(parts["intents"]))) == sorted(map(str, rows(intent_summary(c))))
    assert sorted(map(str, rows(parts["repeated"]))) == sorted(map(str, rows(repeated_groups(c.messages))))


def test_rules_run_once_and_not_again_with_a_memo(spark, corpus, tmp_path, monkeypatch):
    calls = []
    real = intents.intent_struct
    monkeypatch.setattr(intents, "intent_struct", lambda *a, **k: calls.append(1) or real(*a, **k))
    parts = summarize(corpus, memo=f"{tmp_path}/memo")
    assert len(calls) == 1
    for name, part in parts.items():
        plan = part._jdf.queryExecution().toString()
        assert "sounds good" not in plan and "investigate" not in plan, name
    first = {name: sorted(map(str, rows(part))) for name, part in parts.items()}
    again = summarize(corpus, memo=f"{tmp_path}/memo")
    assert len(calls) == 1  # nothing is new
    assert {name: sorted(map(str, rows(part))) for name, part in again.items()} == first
    one = memo.read_memo(spark, f"{tmp_path}/memo").count()
    assert one == corpus.messages.filter(memo.is_submitted()).select("content").distinct().count()
    # Two writers, or other rules, do no harm.
    memo.classified(memo.distinct_prompts(corpus.messages)).write.mode("append").parquet(f"{tmp_path}/memo")
    assert memo.read_memo(spark, f"{tmp_path}/memo").count() == one
    assert memo.read_memo(spark, f"{tmp_path}/memo", ["another app"]).isEmpty()
