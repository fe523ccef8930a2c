import json
import random
import re
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logloom.functions import intents as I
from logloom.functions.content import submitted_prompt_text
from logloom.functions.jsonv import parse_line, str_at
from logloom.functions.project import ProjectAlias, project_name
from logloom.functions.text import normalize_text, redact_text, snippet
from logloom.functions.times import date_preset, day_key, in_range


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def expected_rule(message):
    """The cascade with Python regexes, as a second implementation."""
    literal = re.sub(r"\s+", " ", message.strip()).lower()
    command = re.sub(r"\s+(please|for me)$", "", re.sub(I.COURTESY, "", literal)).strip()
    match = literal if command == literal else f"{literal} {command}"

    def hit(text, patterns):
        return any(re.search(p.replace("{app_names}", "|".join(I.APP_NAMES)), text, re.ASCII) for p in patterns)

    bare = re.sub(r"\s*,\s*", ", ", re.sub(r"[.!]+$", "", literal)).strip()
    tests = [len(literal) <= 80 and hit(bare, I.APPROVAL), not hit(command, [I.RELEASE_NOTES]) and hit(command, I.DEPLOY),
             hit(command, I.GIT), hit(command, I.RUN_BUILD), hit(command, I.REVIEW), hit(match, I.TESTING),
             hit(match, I.DOCUMENTATION), hit(literal, I.DIRECT_FIX) or hit(command, I.DIRECT_FIX),
             hit(match, I.BUG) and hit(match, I.STRONG_FEATURE), hit(match, I.BUG), hit(match, I.PLANNING), hit(match, I.DATA),
             hit(match, I.CONTENT), hit(match, I.STRONG_FEATURE), hit(match, I.CLEANUP), hit(match, I.DESIGN),
             hit(match, I.IMPLEMENTATION), hit(match, I.RESEARCH), hit(match, I.CONTEXT), hit(match, I.BROAD_ACTION),
             literal != ""]
    return next((i for i, t in enumerate(tests, 1) if t), len(I.RULES))


def test_rules_agree_with_python_on_random_prompts(spark):
    text = " ".join(p for n in dir(I) if n.isupper() and isinstance(getattr(I, n), list) for p in getattr(I, n)
                    if isinstance(p, str))
    words = sorted(set(re.findall(r"[a-z']+", text))) + ["éfix", "context:", "context:now", "p1", "the", "zebra", "ok,", "please", "commit?"]
    rnd = random.Random(11)
    prompts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7))) for _ in range(4000)]
    prompts += ["", "  ", "YES!!", "ok, go ahead.", "Are all files committed?", "let's please ship it", "context: something zz",
                "is the work that we pushed zz", "zz qq", "/plan it"]
    prompts += ["i want the application to x", "I want Codex to nap", "zebra " * 3000 + "doesn't work", "q " * 500 + "notarization",
                "move the big menu zz", "some notarize zz", "bug fixe", "make it all better"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, content string").repartition(8)
    got = {r.i: r.rule_no for r in I.with_intent(df).select("i", "rule_no").collect()}
    wrong = [(p, got[i], expected_rule(p)) for i, p in enumerate(prompts) if got[i] != expected_rule(p)]
    assert not wrong, wrong[:5]
    assert len(set(got.values())) >= 20


def test_signals_and_labels(spark):
    df = spark.createDataFrame([("please deploy it",), ("hmm please",)], "content string")
    got = {r.content: r for r in I.with_intent(df).collect()}
    assert got["please deploy it"].signals == ["deploy-release", "normalized-command"]
    assert got["please deploy it"].intent_label == "Deploy/release/run/build"
    assert got["hmm please"].signals == ["non-empty"]


def test_redaction(spark):
    secret = "mail a.b@c.org,x@y.io-z@q.net /Users/ana/work token: \"a b\" api-key=zz ghp_" + "a" * 22 + " password = 'x y' é_token=1"
    out = one(spark, redact_text(F.lit(secret)))
    assert out == ("mail [redacted-email],[redacted-email][redacted-email] ~/work token=[redacted-secret] "
                   "api-key=[redacted-secret] [redacted-token] password=[redacted-secret] é_token=1")


@pytest.mark.parametrize("content,query,want", [
    ("  Alpha\n\n beta gamma ", "alpha BETA", "Alpha\n\n beta gamma"),
    ("x" * 50 + " needle  phrase " + "y" * 300, "needle phrase", "..." + "x" * 31 + " needle  phrase " + "y" * 193 + "..."),
    ("z" * 300, "", "z" * 240 + "..."), ("50% of a_b", "50% of", "50% of a_b"), ("short", "absent", "short")])
def test_snippet(spark, content, query, want):
    assert one(spark, snippet(F.lit(content), query)) == want


def test_normalize_uses_unicode_spaces(spark):
    assert one(spark, normalize_text(F.lit("﻿ A  b\tC "))) == "a b c"


def test_prompt_text(spark):
    wrapped = "# Diff comments:\n\n## Comment 1\nComment:\nuse a set\n\n## Comment 2\nComment:\nrename\n\n## My request for Codex:\n<image>\n"
    assert one(spark, submitted_prompt_text(F.lit(wrapped))) == "use a set\n\nrename"
    browser = ("# Diff comments:\n\n## Comment 1\nComment:\nmove it\n\n# In app browser (IAB):\nx\n## My request for Codex:\n"
               "The next image shows the page at the time of Comment 1. It is outlined in blue.\n")
    assert one(spark, submitted_prompt_text(F.lit(browser))) == "move it"
    assert one(spark, submitted_prompt_text(F.lit(" plain\r\ntext "))) == "plain\ntext"


def test_json_is_strict(spark):
    def text(line, path="$.a"):
        return one(spark, str_at(parse_line(F.lit(line)), path))

    assert text('{"a": "x"}') == "x" and text('{"a": 5}') is None and text('{"a": "1", "a": "2"}') == "2"
    assert text('{"a": "x"} y') is None and text('{"a": "x"},{"a": "y"}') is None


def test_days_and_ranges(spark):
    df = spark.createDataFrame([("2026-01-05T23:59:59.999Z",), ("2026-01-06",), ("10:00",), (None,)], "t string")
    assert [r[0] for r in df.select(day_key(F.col("t"))).collect()] == ["2026-01-05", "2026-01-06", "unknown", "unknown"]
    kept = df.filter(in_range(F.col("t"), "2026-01-01", "2026-01-05"))
    assert [r.t for r in kept.collect()] == ["2026-01-05T23:59:59.999Z", "10:00", None]


def test_presets():
    today = date(2026, 3, 18)
    assert date_preset("week", date(2026, 3, 18), today) == ("2026-03-15", "2026-03-18")
    assert date_preset("month", date(2026, 2, 3), today) == ("2026-02-01", "2026-02-28")
    assert date_preset("day", date(2027, 1, 1), today) == ("2026-03-18", "2026-03-18")
    assert date_preset("custom", today, today, date(2026, 3, 9), date(2026, 3, 1)) == ("2026-03-09", "2026-03-09")
    assert date_preset("all", today, today) == (None, None)


def test_project_names(spark):
    aliases = (ProjectAlias("First", ("shared",)), ProjectAlias("Second", ("shared", "tools")))
    df = spark.createDataFrame([("/a/shared/x",), ("/a//tools/",), ("/h/.codex/worktrees/1/proj",), ("/a/b/../c",), (None,)], "c string")
    assert [r[0] for r in df.select(project_name(F.col("c"), aliases)).collect()] == [
        "First", "Second", "proj", "c", "Unknown Project"]
    assert rows(df.limit(0)) == [] and json.dumps({}) == "{}"


def _starts(items, heads):
    """What a pattern can match, up to its first wildcard (marked); ``|`` marks a word boundary."""
    from re import _constants as C
    for op, arg in items:
        done = {h for h in heads if h.endswith("\0")}
        live = heads - done
        if op is C.SUBPATTERN:
            live = _starts(arg[-1], live)
        elif op is C.BRANCH:
            live = set().union(*[_starts(b, live) for b in arg[1]])
        elif op is C.MAX_REPEAT and arg[:2] == (0, 1):
            live = live | _starts(arg[2], live)
        else:
            more = {C.LITERAL: lambda: [chr(arg)], C.IN: lambda: [chr(a) for _, a in arg], C.AT: lambda: ["|"]}
            live = {h + c for h in live for c in more.get(op, lambda: ["\0"])()}
        heads = done | live
    return heads


def test_key_words_cover_every_pattern():
    import re
    from re import _parser as P

    from logloom.functions import intents
    for name in [n for n in vars(intents) if n.isupper() and isinstance(vars(intents)[n], list) and n not in ("OPERATIONAL", "RULES", "APP_NAMES", "APPROVAL")]:
        anywhere = [p for p in getattr(intents, name) if not p.startswith("^")]
        assert bool(anywhere) == (name in intents.KEY_WORDS) and all(p.startswith(r"\b") for p in anywhere)
        for pattern in anywhere:
            for text in _starts(P.parse(pattern.replace("{app_names}", "(?:[a-z ]+)")), {""}):
                whole = re.findall(r"(?<![a-z0-9_])[a-z0-9_]+(?![a-z0-9_\0])", text)
                assert set(whole) & set(intents.KEY_WORDS[name].split()), (name, text)


def test_rules_run_once_per_text(spark):
    from logloom.operators import evals, prompts
    gold = spark.createDataFrame([("a", "fix the crash", "bug-fixes", None), ("b", "Rename it", "research", None)],
                                 "id string, message string, expected_key string, previous_key string")
    rows = evals.classify_gold(gold)
    said = spark.createDataFrame([("f", n, 0, "s", "codex", "event_msg.user_message", "user", "2026-01-01T00:00:00Z", t) for n, t in enumerate(("Look  at", "look AT", " "))],
                                 "file_path string, line long, seq int, session_id string, provider string, source_event string, role string, timestamp string, content string")
    runs = {}
    for name, df in {"counts": evals.classifier_counts(rows), "check": evals.classifier_categories(rows), "mismatches": evals.classifier_mismatches(rows),
                     "repeated": prompts.repeated_groups(said), "variants": prompts.repeated_variants(said)}.items():
        runs[name] = df._jdf.queryExecution().optimizedPlan().toString().count("ai worklog")
    assert runs == {"counts": 1, "check": 1, "mismatches": 0, "repeated": 1, "variants": 0}  # 4, 2, 2, 2 and more before; written tables have 0
    assert [(r.sample, r["count"]) for r in prompts.repeated_groups(said).collect()] == [("Look at", 2)]
    assert sorted((r.kind, r["name"], r["count"]) for r in evals.classifier_counts(rows).collect()) == [
        ("confidence", "high", 2), ("confusion", "research", 1), ("rule", "direct-bug-fix", 1), ("rule", "refactor-cleanup", 1)]
