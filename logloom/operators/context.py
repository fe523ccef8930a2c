"""Session context: directory, project and turn models of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.project import ProjectAlias, provider_project
from logloom.schema import Corpus

SESSION = ["file_path", "session_id"]


def turn_models(turns: DataFrame) -> DataFrame:
    """Model per (file, session, turn); the last turn row wins, a missing model is ``unknown``."""
    return turns.groupBy(*SESSION, "turn_id").agg(
        F.max_by(F.coalesce("model", F.lit("unknown")), "line").alias("model"))


def attach_model(df: DataFrame, turns: DataFrame) -> DataFrame:
    """Left join of the turn's model (null without a turn row)."""
    return df.join(turn_models(turns), SESSION + ["turn_id"], "left")


def session_contexts(corpus: Corpus, aliases: Sequence[ProjectAlias] = (), with_provider: bool = False) -> DataFrame:
    """One row per (file, session) known to files, sessions or turns: first session row, cwd and project (and the provider that decides it).

    The directory is the first session row's, else the first turn row's.
    """
    s, t, f = corpus.sessions, corpus.turns, corpus.files
    none = F.lit(None).cast("string")
    parts = (
        s.select(*SESSION, F.lit(1).alias("k"), "line", "cwd", "provider", "timestamp", "title",
                 "provider_conversation_id")
        .unionByName(t.select(*SESSION, F.lit(2).alias("k"), "line", "cwd", "provider", none.alias("timestamp"),
                              none.alias("title"), none.alias("provider_conversation_id")))
        .unionByName(f.select(*SESSION, F.lit(3).alias("k"), F.lit(0).cast("bigint").alias("line"),
                              none.alias("cwd"), "provider", none.alias("timestamp"), none.alias("title"),
                              none.alias("provider_conversation_id")))
    )

    def first(kind: int):
        row = F.struct("cwd", "provider", "timestamp", "title", "provider_conversation_id")
        return F.min_by(row, F.when(F.col("k") == kind, F.coalesce("line", F.lit(0))))

    ctx = parts.groupBy(*SESSION).agg(first(1).alias("s"), first(2).alias("t"), first(3).alias("f"))
    cwd = F.coalesce("s.cwd", "t.cwd")
    provider = F.coalesce("s.provider", "t.provider", "f.provider", F.lit("codex"))
    return ctx.select(
        *SESSION, cwd.alias("cwd"), provider_project(provider, cwd, aliases).alias("project"),
        F.col("s.timestamp").alias("session_timestamp"), F.col("s.title").alias("session_title"),
        F.col("s.provider_conversation_id").alias("session_conversation_id"), *([provider.alias("context_provider")] if with_provider else []),
    )


def attach_project(df: DataFrame, corpus: Corpus, aliases: Sequence[ProjectAlias] = (),
                   keep_cwd: bool = False) -> DataFrame:
    """Left join project (and optionally the session's cwd as ``session_cwd``)."""
    ctx = session_contexts(corpus, aliases)
    cols = [*SESSION, "project"] + ([F.col("cwd").alias("session_cwd")] if keep_cwd else [])
    fallback = provider_project(F.coalesce(F.col("provider"), F.lit("codex")) if "provider" in df.columns
                                else F.lit("codex"), F.lit(None).cast("string"))
    joined = df.join(ctx.select(*cols).withColumnRenamed("project", "_project"), SESSION, "left")
    return joined.withColumn("project", F.coalesce("_project", fallback)).drop("_project")


def sessions_by_id(sessions: DataFrame) -> DataFrame:
    """The last session row of every id, in corpus order."""
    cols = [c for c in sessions.columns if c != "session_id"]
    last = sessions.groupBy("session_id").agg(
        F.max_by(F.struct(*cols), F.struct("file_path", F.coalesce("line", F.lit(0)))).alias("r"))
    return last.select("session_id", "r.*")
