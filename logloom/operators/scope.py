"""Filters that decide which records a summary sees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.content import is_submitted
from logloom.functions.project import ALL_PROJECTS, WORKTREE_PART, ProjectAlias, clean_path, project_name
from logloom.functions.times import day_key, in_range, parse_ts
from logloom.operators.context import SESSION, attach_project
from logloom.schema import Corpus, record_provider


@dataclass(frozen=True)
class Scope:
    """Options shared by summaries, searches, evaluations and audits."""

    project: str | None = None
    since: str | None = None
    until: str | None = None
    provider: str | None = None
    aliases: Sequence[ProjectAlias] = ()

    @property
    def one_project(self) -> str | None:
        return None if self.project in (None, "", ALL_PROJECTS) else self.project

    @property
    def has_dates(self) -> bool:
        return bool(self.since or self.until)


def provider_in_scope(provider: str | None) -> Column:
    if not provider or provider == "all":
        return F.lit(True)
    return record_provider() == provider


def visible_files(corpus: Corpus, scope: Scope) -> DataFrame:
    """Files of the provider whose own session belongs to the project."""
    files = corpus.files.filter(provider_in_scope(scope.provider))
    if scope.one_project:
        files = attach_project(files, corpus, scope.aliases).filter(F.col("project") == scope.one_project)
        files = files.drop("project")
    return files


def scoped_corpus(corpus: Corpus, scope: Scope) -> Corpus:
    """Records of visible files (kept by file path alone) inside the date range; warnings have their own rule."""
    files = visible_files(corpus, scope)
    restrict = bool(scope.one_project or (scope.provider and scope.provider != "all"))
    paths = files.select("file_path").distinct()

    def keep(name: str, df: DataFrame) -> DataFrame:
        if name == "files":
            return files
        if name == "warnings":
            return warnings_in_scope(corpus, scope)
        if restrict:
            df = df.join(paths, "file_path", "left_semi")
        if scope.has_dates and "timestamp" in df.columns and name != "sessions":
            df = df.filter(in_range(F.col("timestamp"), scope.since, scope.until))
        return df

    return corpus.map(keep)


def timestamped_records(corpus: Corpus, names: Sequence[str] = (
        "sessions", "messages", "turns", "token_usage", "tool_events", "unknown_events")) -> DataFrame:
    """(file, session, timestamp) of every record of the named tables."""
    out = None
    for name in names:
        part = getattr(corpus, name).select(*SESSION, "timestamp")
        out = part if out is None else out.unionByName(part)
    return out


def warnings_in_scope(corpus: Corpus, scope: Scope) -> DataFrame:
    """Warnings of visible files; with dates only files active in the range, or without any timestamp."""
    files = visible_files(corpus, scope)
    if not scope.has_dates:
        return corpus.warnings.join(files.select("file_path").distinct(), "file_path", "left_semi")
    records = timestamped_records(corpus)
    seen = records.groupBy(*SESSION).agg(
        F.bool_or(in_range(F.col("timestamp"), scope.since, scope.until)).alias("active"),
        F.bool_or(F.coalesce(F.col("timestamp") != "", F.lit(False))).alias("dated"))
    keep = files.select(*SESSION).join(seen, SESSION, "left").filter(
        F.coalesce("active", F.lit(False)) | ~F.coalesce("dated", F.lit(False)))
    return corpus.warnings.join(keep.select("file_path").distinct(), "file_path", "left_semi")


def repo_scope(cwd: Column, project: Column, repo_path: str, aliases: Sequence[ProjectAlias] = ()) -> Column:
    """Directory inside the repository, or a worktree of it; without a directory the project name decides."""
    repo = repo_path.rstrip("/") or "/"
    base = repo.rsplit("/", 1)[-1]
    path = clean_path(cwd)
    inside = (path == repo) | path.startswith(repo.rstrip("/") + "/")
    worktree = path.contains(WORKTREE_PART) & (project_name(cwd, aliases) == base)
    return F.when(cwd.isNull() | (cwd == ""), project == base).otherwise(inside | worktree)


def hidden_category(category: Column, *hidden: Sequence[str]) -> Column:
    """Keep rows without a category or with one that no list hides."""
    names = [h for group in hidden for h in group]
    return category.isNull() | ~category.isin(*names) if names else F.lit(True)


def last_days_of_data(df: DataFrame, days: int, column: str = "timestamp") -> DataFrame:
    """Rows of the last days before the latest instant in the data; rows without an instant drop."""
    newest = df.agg((F.max(parse_ts(F.col(column))) - F.expr(f"INTERVAL {int(days)} DAYS")).alias("cutoff")).scalar()
    return df.filter(parse_ts(F.col(column)) >= newest)


def visible_session(corpus: Corpus, session_id: str, file_path: str | None = None, date_key: str | None = None,
                    scope: Scope = Scope()) -> DataFrame:
    """The first file that holds the session and passes every filter (at most one row)."""
    files = corpus.files.filter(F.col("session_id") == session_id).filter(provider_in_scope(scope.provider))
    if file_path:
        files = files.filter(F.col("file_path") == file_path)
    if scope.one_project:
        files = attach_project(files, corpus, scope.aliases).filter(F.col("project") == scope.one_project)
        files = files.drop("project")
    dated = in_range(F.col("timestamp"), scope.since, scope.until)
    if date_key:
        prompts = corpus.messages.filter(is_submitted() & (day_key(F.col("timestamp")) == date_key) & dated)
        files = files.join(prompts.select("file_path").distinct(), "file_path", "left_semi")
    if scope.has_dates:
        records = timestamped_records(corpus, ("sessions", "messages", "turns", "token_usage")).filter(dated)
        files = files.join(records.select("file_path").distinct(), "file_path", "left_semi")
    return files.orderBy("file_path", "session_id").limit(1)


def automation_messages(messages: DataFrame, date_key: str | None = None) -> DataFrame:
    out = messages.filter(F.col("source_event") == "event_msg.automation_message")
    return out.filter(day_key(F.col("timestamp")) == date_key) if date_key else out
