"""Daily facts against the direct operators, after files were added, grown, replaced and removed."""

import json
import os
import random
from collections import Counter

import pytest
from conftest import at, event
from test_growth import append, claude_lines, codex_lines

from logloom import Scope
from logloom.operators import facts, refresh, sessions, snapshots, tokens
from logloom.plans.summary import summary_totals


def same(direct, from_facts):
    assert sorted(direct.columns) == sorted(from_facts.columns)
    names = sorted(direct.columns)
    assert Counter(map(str, direct.select(names).collect())) == Counter(map(str, from_facts.select(names).collect()))


def compare(spark, cache, scope):
    from logloom.operators.scope import scoped_corpus

    whole = refresh.read_cache(spark, cache)
    c, f = scoped_corpus(whole, scope), facts.Facts(spark, cache, scope)
    same(summary_totals(whole, scope), f.totals())
    for grain in ("day", "hour"):
        same(tokens.message_buckets(c.messages, c.token_usage, grain), f.message_buckets(grain))
        same(tokens.token_buckets(c.token_usage, grain), f.token_buckets(grain))
    same(tokens.provider_usage(c.files, c.messages, c.token_usage), f.provider_usage())
    same(sessions.session_days(whole, scope), f.session_days())
    same(sessions.list_projects(whole, scope.aliases), f.list_projects())


def test_facts_equal_the_direct_operators(spark, tmp_path):
    rng, root, cache = random.Random(12), str(tmp_path / "in"), str(tmp_path / "cache")
    paths = [f"{root}/a.jsonl", f"{root}/b.jsonl", f"{root}/.claude/projects/p/c.jsonl"]
    for path, lines in zip(paths, (codex_lines, codex_lines, claude_lines)):
        append(path, lines(rng, 40, 0))
    refresh.refresh_corpus(spark, cache, [root])
    assert facts.update_facts(spark, cache, f"{tmp_path}/memo") == 3 and facts.update_facts(spark, cache, f"{tmp_path}/memo") == 0
    before = {os.path.join(d, x) for d, _, names in os.walk(f"{cache}/facts") for x in names}
    append(paths[0], codex_lines(rng, 20, 60))  # grown
    with open(paths[2], "w") as f:
        f.write("\n".join(claude_lines(rng, 9, 300)) + "\n")  # replaced
    os.remove(paths[1])
    append(f"{root}/d.jsonl", [json.dumps(event(0, "session_meta", id="S9", cwd="/w/new", timestamp=at(0)))] + codex_lines(rng, 10, 0))
    refresh.refresh_corpus(spark, cache, [root])
    assert facts.update_facts(spark, cache, f"{tmp_path}/memo") == 3
    assert before <= {os.path.join(d, x) for d, _, names in os.walk(f"{cache}/facts") for x in names}  # nothing was rewritten
    compare(spark, cache, Scope())
    compare(spark, cache, Scope(project="a", provider="codex"))
    snapshots.compact(spark, cache)
    assert facts.update_facts(spark, cache) == 0
    same(summary_totals(refresh.read_cache(spark, cache)), facts.Facts(spark, cache).totals())
    with pytest.raises(ValueError):
        facts.Facts(spark, cache, Scope(since="2026-01-01"))


def test_totals_read_two_tables(spark, tmp_path):
    """Sums and digests, and the few rows about files: no record table is read."""
    root, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    append(f"{root}/a.jsonl", codex_lines(random.Random(1), 20, 0))
    refresh.refresh_corpus(spark, cache, [root])
    facts.update_facts(spark, cache)
    plan = facts.Facts(spark, cache).totals()._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"/data/{name}/" in plan for name in ("messages", "turns", "token_usage", "tool_events", "unknown_events"))
