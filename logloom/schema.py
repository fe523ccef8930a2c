"""Record tables: column names and types, and the corpus that bundles them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE_FIELDS = [
    "input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
    "fresh_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens",
]
USAGE_TYPE = "struct<" + ",".join(f"{f}:bigint" for f in USAGE_FIELDS) + ">"

_META = "provider string, input_kind string, source_label string, title string, provider_conversation_id string, "
_KEY = "file_path string, session_id string, "

TABLE_DDL = {
    "files": _META + _KEY + "line_count bigint",
    "sessions": _META + _KEY + "line bigint, timestamp string, cwd string, originator string, cli_version string, "
                "source string, model_provider string",
    "turns": _META + _KEY + "line bigint, turn_id string, timestamp string, cwd string, current_date string, "
             "timezone string, model string, effort string, collaboration_mode string",
    "messages": _META + _KEY + "line bigint, seq int, turn_id string, timestamp string, role string, "
                "source_event string, content string, phase string, images_count int, local_images_count int",
    "token_usage": _META + _KEY + "line bigint, turn_id string, timestamp string, usage " + USAGE_TYPE
                   + ", cumulative_usage " + USAGE_TYPE + ", model_context_window bigint, rate_limits string",
    "task_timings": _META + _KEY + "turn_id string, started_at double, completed_at double, duration_ms double, "
                    "time_to_first_token_ms double, last_agent_message string",
    "tool_events": _META + _KEY + "line bigint, seq int, turn_id string, timestamp string, event_type string, "
                   "name string, call_id string, content string, cwd string, exit_code bigint, duration_ms double",
    "unknown_events": _META + _KEY + "line bigint, timestamp string, top_level_type string, payload_type string, "
                      "raw_truncated boolean, raw string",
    "warnings": _META + "file_path string, line bigint, code string, message string",
}
TABLES = list(TABLE_DDL)


@dataclass(frozen=True)
class Corpus:
    """The nine record tables of one load."""

    files: DataFrame
    sessions: DataFrame
    turns: DataFrame
    messages: DataFrame
    token_usage: DataFrame
    task_timings: DataFrame
    tool_events: DataFrame
    unknown_events: DataFrame
    warnings: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def map(self, fn) -> "Corpus":
        """Apply ``fn(name, df)`` to every table."""
        return replace(self, **{name: fn(name, df) for name, df in self.tables().items()})


def conform(name: str, df: DataFrame) -> DataFrame:
    """Project ``df`` to the declared columns of table ``name``; absent columns become null."""
    schema = empty_schema(df.sparkSession, name)
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def empty_schema(spark: SparkSession, name: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TABLE_DDL[name])


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], empty_schema(spark, name))


def corpus_from_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> Corpus:
    """Build a corpus from any subset of tables; the missing ones are empty."""
    return Corpus(**{n: conform(n, tables[n]) if n in tables else empty_table(spark, n) for n in TABLES})


def union_corpora(parts: list[Corpus]) -> Corpus:
    """All record tables of several providers in one corpus."""
    first, *rest = parts
    merged = first.tables()
    for part in rest:
        other = part.tables()
        merged = {n: merged[n].unionByName(other[n], allowMissingColumns=True) for n in TABLES}
    return Corpus(**merged)


def record_provider(col: str | Column = "provider") -> Column:
    """A record without a provider counts as codex."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("codex"))
