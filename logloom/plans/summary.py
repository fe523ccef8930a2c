"""The usage summary: one DataFrame per part, redaction and exports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.content import is_automation_message, is_submitted
from logloom.functions.project import ALL_PROJECTS
from logloom.functions.text import REDACTED
from logloom.operators.context import SESSION
from logloom.operators.memo import annotated, grouped, prompt_memo
from logloom.operators.prompts import (intent_projects, intent_summary, intent_totals, repeated_groups, repeated_projects,
                                       repeated_prompts, repeated_variants)
from logloom.operators.scope import Scope, scoped_corpus, visible_session
from logloom.operators.search import with_category
from logloom.operators.sessions import activity_range, session_days
from logloom.operators.tokens import message_buckets, model_usage, provider_usage, token_buckets, token_totals
from logloom.schema import Corpus
from logloom.session import stage_table

TOTALS = ["sessions", "turns", "user_messages", "automation_messages", "assistant_messages", "unique_user_messages",
          "tool_events", "unknown_events", "parse_warnings"]


def summary_totals(corpus: Corpus, scope: Scope = Scope()) -> DataFrame:
    """One row of counts."""
    return _totals(scoped_corpus(corpus, scope), session_days(corpus, scope))


def _totals(c: Corpus, sessions: DataFrame) -> DataFrame:
    # One pass over the messages: only submitted prompts have a text to group by.
    text = F.col("digest" if "digest" in c.messages.columns else "content")
    said = grouped(c.messages.withColumn("prompt", F.when(is_submitted(), text)), "prompt")
    counts = said.agg(
        F.count("prompt").alias("user_messages"), F.count_if(is_automation_message()).alias("automation_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.count_distinct("group_key").alias("unique_user_messages"))

    def n(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    return counts.select(
        n(sessions).alias("sessions"), n(c.turns).alias("turns"), "user_messages",
        "automation_messages", "assistant_messages", "unique_user_messages", n(c.tool_events).alias("tool_events"),
        n(c.unknown_events).alias("unknown_events"), n(c.warnings).alias("parse_warnings"))


def summarize(corpus: Corpus, scope: Scope = Scope(), repeated_limit: int = 10, memo: str | None = None) -> dict[str, DataFrame]:
    """Every part of the summary.  Lists that grow with the data are tables of their own.

    ``repeated_limit`` bounds the list of repeated prompts; ``repeated_total`` counts all of their groups.  Each distinct prompt is classified once, and with
    the folder ``memo`` once over all runs; all parts read the annotated messages, without texts.
    """
    c = scoped_corpus(corpus, scope)
    said = annotated(c.messages, prompt_memo(c.messages, memo))
    c = replace(c, messages=said)
    # Contexts come from the whole corpus: a date range does not change where a session ran.
    wide = Corpus(**{**corpus.tables(), "messages": c.messages})
    sessions = session_days(corpus, scope)
    repeated = repeated_prompts(c.messages, repeated_limit)
    intents = intent_summary(wide, scope.aliases)
    return {
        "totals": _totals(c, sessions),
        "activity": activity_range(sessions),
        "tokens": token_totals(c.token_usage),
        "messages_by_day": message_buckets(c.messages, c.token_usage, "day"),
        "messages_by_hour": message_buckets(c.messages, c.token_usage, "hour"),
        "tokens_by_day": token_buckets(c.token_usage, "day"),
        "models": model_usage(c.turns, c.token_usage),
        "providers": provider_usage(c.files, c.messages, c.token_usage),
        "sessions": sessions,
        "intents": intents,
        "intent_totals": intent_totals(intents),
        "intent_projects": intent_projects(wide, scope.aliases),
        "repeated": repeated,
        "repeated_total": repeated_groups(c.messages).agg(F.count(F.lit(1)).alias("groups")),
        "repeated_variants": repeated_variants(c.messages, repeated),
        "repeated_projects": repeated_projects(wide, scope.aliases),
    }


# Columns that a redacted export hides.
REDACTED_COLUMNS = {
    "sessions": ["title", "provider_conversation_id", "file_path", "cwd"],
    "intents": ["examples"],
    "repeated": ["id", "sample", "group_key"],
    "repeated_variants": ["id", "sample", "group_key"],
    "repeated_projects": ["id", "group_key"],
}


def redact_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace present values by a placeholder; arrays keep their length, absent values stay absent."""
    types = dict(df.dtypes)
    out = {}
    for name in names:
        if types.get(name, "").startswith("array"):
            out[name] = F.transform(name, lambda _: F.lit(REDACTED))
        elif name in types:
            out[name] = F.when(F.col(name) != "", F.lit(REDACTED))
    return df.withColumns(out)


def redact_summary(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: redact_columns(df, REDACTED_COLUMNS.get(name, [])) for name, df in parts.items()}


def metrics_long(parts: dict[str, DataFrame], project: str = ALL_PROJECTS) -> DataFrame:
    """(position, metric, value): totals, tokens, one row per intent and two per provider.

    The small inputs (one row, or one per intent or provider) are staged, so each is computed once.
    """
    parts = {**parts, **{n: stage_table(parts[n]) for n in ("totals", "providers", "intents")}}
    parts["intent_totals"] = intent_totals(parts["intents"])
    def rows(df: DataFrame, start: int, named: dict[str, str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(start + i).alias("position"), F.lit(metric).alias("metric"),
                                   F.col(column).cast("string").alias("value"))
                          for i, (metric, column) in enumerate(named.items())])
        return df.select(F.explode(pairs).alias("r")).select("r.*")

    def text(c) -> F.Column:
        return c.cast("string")

    providers = parts["providers"]
    names = providers.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        (-F.col("messages")).alias("m"), "provider"))), lambda x: x["provider"]), "|").alias("p"))
    repeated = parts["repeated"].agg(F.count(F.lit(1)).alias("n"))
    fixed = [
        rows(parts["totals"].withColumn("project", F.lit(project)), 0, {n: n for n in ["project", *TOTALS[:6]]}),
        rows(parts["repeated_total"], 9, {"repeated_user_message_groups": "groups"}),
        rows(repeated, 10, {"repeated_user_messages": "n"}), rows(names, 11, {"providers": "p"}),
        rows(parts["intent_totals"], 12, {f"prompt_intent_{n}": n for n in ("classified_messages",
                                                                          "unclassified_messages")}),
        rows(parts["tokens"], 20, {n: n for n in ("input_tokens", "cached_input_tokens", "fresh_input_tokens",
                                                  "output_tokens", "reasoning_output_tokens", "total_tokens")}),
        rows(parts["totals"], 30, {n: n for n in ("unknown_events", "parse_warnings")}),
    ]
    per_intent = parts["intents"].select(
        F.lit(100).alias("position"), F.concat(F.lit("prompt_intent_"), F.col("intent_key")).alias("metric"),
        text(F.col("count")).alias("value"))
    per_provider = providers.select(F.explode(F.array(*[
        F.struct(F.lit(200 + i).alias("position"), F.concat(F.lit("provider_"), F.col("provider"), F.lit(f"_{n}"))
                 .alias("metric"), text(F.col(n)).alias("value")) for i, n in enumerate(("messages", "sessions"))]))
        .alias("r")).select("r.*")
    out = per_intent.unionByName(per_provider)
    for part in fixed:
        out = out.unionByName(part)
    return out


def write_summary_json(parts: dict[str, DataFrame], path: str, redacted: bool = True) -> None:
    """One JSON data set per part below ``path``; redacted unless asked otherwise."""
    for name, df in (redact_summary(parts) if redacted else parts).items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_summary_csv(parts: dict[str, DataFrame], path: str, project: str = ALL_PROJECTS) -> None:
    """The long metrics as one CSV file with a header (a few dozen rows)."""
    (metrics_long(parts, project).coalesce(1).sortWithinPartitions("position", "metric").select("metric", "value")
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def report_parity(actual: DataFrame, reference: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Failures of ``actual`` against ``reference``, both (metric, value): missing, or off by more than allowed."""
    joined = reference.select("metric", F.col("value").alias("expected")).filter(F.col("expected").isNotNull()).join(
        actual.select("metric", F.col("value").alias("actual")), "metric", "left")
    allowed = F.lit(0.0) if tolerance == 0 else F.greatest(F.lit(1.0), F.abs("expected") * tolerance)
    delta = F.abs(F.col("actual") - F.col("expected"))
    return joined.filter(F.col("actual").isNull() | (delta > allowed)).select(
        "metric", "expected", "actual", delta.alias("delta"))


def parity_metrics(parts: dict[str, DataFrame]) -> DataFrame:
    """Numbers a parity check compares, as (metric, value): totals, tokens, models and day buckets."""
    usage = ["input_tokens", "cached_input_tokens", "fresh_input_tokens", "output_tokens", "reasoning_output_tokens",
             "total_tokens"]

    def long(df: DataFrame, prefix, names: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.concat(prefix, F.lit(f".{n}")).alias("metric"),
                                   F.col(n).cast("double").alias("value")) for n in names])
        return df.select(F.explode(pairs).alias("r")).select("r.*")

    days = F.concat(F.lit("messages_by_day."), F.col("bucket"))
    tokens = F.concat(F.lit("tokens_by_day."), F.col("bucket"))
    return (long(parts["totals"], F.lit("totals"), TOTALS).unionByName(long(parts["tokens"], F.lit("tokens"), usage))
            .unionByName(long(parts["models"], F.concat(F.lit("models."), F.col("model")), ["turns", *usage]))
            .unionByName(long(parts["messages_by_day"], days, ["messages", "unique_messages"]))
            .unionByName(long(parts["tokens_by_day"], tokens, usage)))


def session_detail(corpus: Corpus, session_id: str, file_path: str | None = None, date_key: str | None = None,
                   scope: Scope = Scope()) -> dict[str, DataFrame]:
    """All records of one visible session; messages carry category and intent."""
    file = visible_session(corpus, session_id, file_path, date_key, scope)
    # A rollout holds its records under the file, a chat store under (file, session).
    store = F.col("input_kind") == "cursor-vscdb"
    by_path = file.filter(~F.coalesce(store, F.lit(False))).select("file_path")
    by_chat = file.filter(store).select(*SESSION)

    def own(name: str, df: DataFrame) -> DataFrame:
        if name == "files":
            return file
        if name == "sessions":
            return df.join(F.broadcast(file.select(*SESSION)), SESSION, "left_semi").orderBy("line").limit(1)
        if name == "warnings":
            return df.join(F.broadcast(file.select("file_path")), "file_path", "left_semi")
        a = df.join(F.broadcast(by_path), "file_path", "left_semi")  # at most one row
        return a.unionByName(df.join(F.broadcast(by_chat), SESSION, "left_semi"))

    tables = corpus.map(own).tables()
    tables["messages"] = with_category(tables["messages"])
    return tables
