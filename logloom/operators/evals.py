"""Reviewed evaluation of the prompt intents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.intents import CATEGORIES, category_label, with_intent
from logloom.functions.text import compact, eval_id, normalize_query, normalize_text
from logloom.functions.times import day_key, in_range
from logloom.operators.context import SESSION, attach_project
from logloom.operators.scans import ranked
from logloom.operators.scope import Scope
from logloom.operators.search import clamp_limit, clamp_offset
from logloom.schema import Corpus
from logloom.session import stage_table

REVIEW_DDL = "eval_id string, actual_key string, expected_key string, is_correct boolean, reviewed_at string, note string"


@dataclass(frozen=True)
class EvalOptions(Scope):
    query: str = ""
    category_key: str | None = None
    review_state: str = "all"
    include_correct: bool = True
    include_incorrect: bool = True
    limit: int | None = None
    offset: int | None = None


def round3(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round3(part / whole))


def eval_messages(corpus: Corpus, reviews: DataFrame, o: EvalOptions = EvalOptions()) -> DataFrame:
    """Codex prompts with their intent and review; correctness follows from the current rules."""
    m = corpus.messages.filter(F.col("source_event") == "event_msg.user_message")
    if o.has_dates:
        m = m.filter(in_range(F.col("timestamp"), o.since, o.until))
    if normalize_query(o.query):
        m = m.filter(normalize_text(F.col("content")).contains(F.lit(normalize_query(o.query))))
    m = attach_project(m, corpus, o.aliases, keep_cwd=True)
    if o.one_project:
        m = m.filter(F.col("project") == o.one_project)
    m = with_intent(m)
    m = m.withColumn("eval_id", eval_id(*[F.col(c) for c in (*SESSION, "line", "turn_id", "timestamp", "content")]))
    r = reviews.select("eval_id", "expected_key", "reviewed_at", "note", F.lit(True).alias("reviewed"))
    out = m.join(r, "eval_id", "left")
    return out.select(
        "eval_id", *SESSION, day_key(F.col("timestamp")).alias("date_key"), "project",
        F.col("session_cwd").alias("cwd"), "line", "turn_id", "timestamp", "intent_key", "intent_label", "rule_key",
        "rule_label", "confidence", "signals", compact(F.col("content"), 240).alias("snippet"), "content",
        F.coalesce("reviewed", F.lit(False)).alias("reviewed"), "expected_key",
        F.when(F.col("reviewed"), F.col("expected_key") == F.col("intent_key")).alias("is_correct"), "reviewed_at",
        "note")


def eval_filter(messages: DataFrame, o: EvalOptions) -> DataFrame:
    out = messages
    if (o.category_key or "").strip():
        out = out.filter(F.col("intent_key") == o.category_key.strip())
    state = {"unreviewed": ~F.col("reviewed"), "correct": F.col("is_correct"), "incorrect": ~F.col("is_correct")}
    return out.filter(state[o.review_state]) if o.review_state in state else out


def eval_page(messages: DataFrame, o: EvalOptions) -> DataFrame:
    """One page, newest first; ``rank`` counts from 1 over all matches, and the rows come in its order."""
    order = [F.desc(F.coalesce("timestamp", F.lit(""))), *map(F.col, SESSION), F.coalesce("line", F.lit(0)), F.col("eval_id")]
    page = eval_filter(messages, o).orderBy(*order).offset(clamp_offset(o.offset)).limit(clamp_limit(o.limit, 200))
    return page.withColumn("rank", clamp_offset(o.offset) + F.row_number().over(W.orderBy(*order))).orderBy("rank")


def eval_summary(messages: DataFrame) -> DataFrame:
    """Per category: prompts, reviews, precision (correct of reviewed) and recall (correct of expected)."""
    r = F.col("reviewed")
    ok = F.coalesce("is_correct", F.lit(False))
    predicted = messages.groupBy(F.col("intent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(r).alias("reviewed"), F.count_if(r & ok).alias("correct"),
        F.count_if(r & ~ok).alias("incorrect"), F.count_if(~r).alias("unreviewed"))
    expected = messages.filter(r).groupBy(F.col("expected_key").alias("key")).agg(
        F.count(F.lit(1)).alias("e_reviewed"), F.count_if(ok).alias("e_correct"))
    counts = ["total", "reviewed", "correct", "incorrect", "unreviewed", "e_reviewed", "e_correct"]
    both = predicted.join(expected, "key", "full_outer").select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return both.select("key", category_label(F.col("key")).alias("label"), *counts[:5],
                       ratio(F.col("correct"), F.col("reviewed")).alias("precision"),
                       ratio(F.col("e_correct"), F.col("e_reviewed")).alias("recall"))


def eval_totals(messages: DataFrame) -> DataFrame:
    r = F.col("reviewed")
    ok = F.coalesce("is_correct", F.lit(False))
    sums = messages.agg(F.count(F.lit(1)).alias("total_messages"), F.count_if(r).alias("reviewed_messages"),
                        F.count_if(r & ok).alias("correct_messages"), F.count_if(r & ~ok).alias("incorrect_messages"))
    return sums.select("*", ratio(F.col("correct_messages"), F.col("reviewed_messages")).alias("reviewed_accuracy"))


def eval_confusions(messages: DataFrame) -> DataFrame:
    """Wrongly predicted reviews per (predicted, expected) pair."""
    pairs = messages.filter(~F.col("is_correct")).groupBy(
        F.col("intent_key").alias("actual_key"), "expected_key").agg(F.count(F.lit(1)).alias("count"))
    return pairs.select("actual_key", category_label(F.col("actual_key")).alias("actual_label"), "expected_key",
                        category_label(F.col("expected_key")).alias("expected_label"), "count")


def eval_report(messages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Totals of the reviewed prompts, and stored reviews without a prompt in scope."""
    stored = reviews.agg(F.count(F.lit(1)).alias("n")).scalar()
    t = eval_totals(messages)
    return t.select(
        stored.alias("stored_reviews"), F.col("reviewed_messages").alias("reviewed_in_scope"),
        F.greatest(F.lit(0), stored - F.col("reviewed_messages")).alias("out_of_scope_or_missing"),
        F.col("total_messages").alias("total_messages_in_scope"), F.col("correct_messages").alias("correct"),
        F.col("incorrect_messages").alias("incorrect"), "reviewed_accuracy")


def eval_report_categories(messages: DataFrame) -> DataFrame:
    """Category table of the report: predicted or expected in a review."""
    done = eval_summary(messages.filter("reviewed"))
    return done.filter((F.col("reviewed") > 0) | (F.col("incorrect") > 0)).select(
        "key", "label", "reviewed", "correct", "incorrect", "precision", "recall")


def upsert_reviews(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Reviews after a batch of changes; a change needs id, actual and expected key, the last of an id wins."""
    whole = changes.filter((F.col("eval_id") != "") & (F.col("actual_key") != "") & (F.col("expected_key") != ""))
    rest = [c for c in ("actual_key", "expected_key", "reviewed_at", "note")]
    last = whole.groupBy("eval_id").agg(F.max_by(F.struct(*rest), F.coalesce("reviewed_at", F.lit(""))).alias("r"))
    last = last.select("eval_id", "r.actual_key", "r.expected_key",
                       (F.col("r.actual_key") == F.col("r.expected_key")).alias("is_correct"), "r.reviewed_at", "r.note")
    return stored.join(last, "eval_id", "left_anti").unionByName(last)


def delete_reviews(stored: DataFrame, eval_ids: DataFrame) -> DataFrame:
    return stored.join(eval_ids.select("eval_id"), "eval_id", "left_anti")


def fixture_draft(messages: DataFrame, o: EvalOptions = EvalOptions()) -> DataFrame:
    """Gold-label drafts of reviewed prompts, numbered per expected category; the prompt text is withheld."""
    rows = messages.filter("reviewed")
    if (o.category_key or "").strip():
        rows = rows.filter(F.col("intent_key") == o.category_key.strip())
    rows = rows.filter((F.col("is_correct") & F.lit(o.include_correct)) | (~F.col("is_correct") & F.lit(o.include_incorrect)))
    rows = rows.select("expected_key", "timestamp", *SESSION, "line", "eval_id", "intent_key", "rule_key", "is_correct")
    numbered = ranked(rows, ["expected_key"], [
        F.desc(F.coalesce("timestamp", F.lit(""))), F.col("file_path"), F.col("session_id"),
        F.coalesce("line", F.lit(0)), F.col("eval_id")], "case_no")
    n = F.col("case_no").cast("string")
    padded = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    word = F.when(F.col("is_correct"), "correct").otherwise("incorrect")
    return numbered.select(
        F.concat(F.lit("reviewed-"), F.col("expected_key"), F.lit("-"), padded).alias("id"),
        F.concat(F.lit("TODO: Replace with a sanitized synthetic prompt for "), category_label(F.col("expected_key")),
                 F.lit(" reviewed case "), n, F.lit(".")).alias("message"), "expected_key",
        F.when(~F.col("is_correct"), F.col("intent_key")).alias("previous_key"),
        F.concat(F.lit("Reviewed "), word, F.lit(". Current classifier: "), category_label(F.col("intent_key")),
                 F.lit(" via "), F.col("rule_key"), F.lit(". Replace this placeholder before committing.")).alias("notes"),
        "is_correct")


def draft_totals(draft: DataFrame) -> DataFrame:
    return draft.agg(F.count(F.lit(1)).alias("reviewed_messages"), F.count_if("is_correct").alias("correct_examples"),
                     F.count_if(~F.col("is_correct")).alias("incorrect_examples"))


def classify_gold(gold: DataFrame) -> DataFrame:
    """Gold labels ``(id, message, expected_key, previous_key)`` with the current prediction."""
    known = list(CATEGORIES)
    checked = gold.withColumn("expected_key", F.when(F.col("expected_key").isin(*known), F.col("expected_key")).otherwise(
        F.raise_error(F.concat(F.lit("unknown category for "), F.col("id")))))
    return with_intent(checked, "message").withColumnRenamed("intent_key", "actual_key")


def classifier_totals(rows: DataFrame, minimum_accuracy: float = 1.0) -> DataFrame:
    sums = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("actual_key") == F.col("expected_key")).alias("correct"))
    accuracy = F.when(F.col("total") > 0, round3(F.col("correct") / F.col("total"))).otherwise(1.0)
    return sums.select("total", "correct", accuracy.alias("accuracy"), F.lit(minimum_accuracy).alias("minimum_accuracy"),
                       ((F.col("correct") == F.col("total")) & (accuracy >= minimum_accuracy)).alias("passed"))


def classifier_categories(rows: DataFrame) -> DataFrame:
    """Per category: expected, predicted, correct, precision (of predicted) and recall (of expected)."""
    # One pass over the texts: what follows reads one row per pair of categories.
    pairs = rows.groupBy("expected_key", "actual_key").agg(F.count(F.lit(1)).alias("n"))
    hit, none = F.when(F.col("actual_key") == F.col("expected_key"), F.col("n")).otherwise(0), F.lit(0).cast("long")

    def side(key: str, expected: Column, predicted: Column, correct: Column) -> Column:
        return F.struct(F.col(key).alias("key"), expected.alias("expected"), predicted.alias("predicted"), correct.alias("correct"))

    sides = F.inline(F.array(side("expected_key", F.col("n"), none, hit), side("actual_key", none, F.col("n"), none)))
    both = pairs.select(sides).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("expected", "predicted", "correct")])
    return both.select("key", category_label(F.col("key")).alias("label"), "expected", "predicted", "correct",
                       ratio(F.col("correct"), F.col("predicted")).alias("precision"),
                       ratio(F.col("correct"), F.col("expected")).alias("recall"))


def classifier_counts(rows: DataFrame) -> DataFrame:
    """Counts per rule and per confidence level, and confusions, as (kind, name, other, count)."""
    # One pass over the texts: what follows reads one row per rule and expected category.
    cells = rows.groupBy("rule_key", "confidence", "expected_key", "actual_key").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")

    def part(kind: str, name: str, other: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), other.alias("other"), F.col("n").alias("n"))

    wrong = F.when(F.col("actual_key") != F.col("expected_key"), part("confusion", "expected_key", F.col("actual_key")))
    parts = F.array_compact(F.array(part("rule", "rule_key"), part("confidence", "confidence"), wrong))
    return cells.select(F.inline(parts)).groupBy("kind", "name", "other").agg(F.sum("n").alias("count"))


def classifier_mismatches(rows: DataFrame) -> DataFrame:
    # Written once: a filter on classified columns would classify every text anew.
    judged = stage_table(rows.select("id", "expected_key", "actual_key", "rule_key", "confidence", "signals",
                                     compact(F.col("message"), 120).alias("message")))
    return judged.filter(F.col("actual_key") != F.col("expected_key"))


def classifier_changes(rows: DataFrame) -> DataFrame:
    """Examples whose prediction differs from their earlier label."""
    moved = rows.filter((F.col("previous_key") != "") & (F.col("previous_key") != F.col("actual_key")))
    return moved.select("id", "previous_key", "actual_key", "expected_key", F.when(
        F.col("actual_key") == F.col("expected_key"), "expected-change").otherwise("unexpected-change").alias("status"))
