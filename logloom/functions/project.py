"""Project names from working directories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_PROJECTS = "All Projects"

# Fixed value: where the tool keeps worktrees.
WORKTREE = r"/\.codex/worktrees/[^/]+/([^/]+)$"
WORKTREE_PART = "/.codex/worktrees/"


@dataclass(frozen=True)
class ProjectAlias:
    """A display name for every directory that contains one of the texts."""

    name: str
    match: tuple[str, ...]


def clean_path(c: Column) -> Column:
    """Path without doubled slashes, ``.`` and ``dir/..`` steps (one level) or trailing slash."""
    flat = F.regexp_replace(c, "/{2,}", "/")
    flat = F.regexp_replace(flat, r"/\.(?=/|\z)", "")
    flat = F.regexp_replace(flat, r"/(?!\.\./)[^/]+/\.\.(?=/|\z)", "")
    return F.regexp_replace(flat, r"(?<=.)/\z", "")


def project_name(cwd: Column, aliases: Sequence[ProjectAlias] = ()) -> Column:
    """First alias that matches, else the worktree's project, else the last path part."""
    path = clean_path(cwd)
    named = F.lit(None).cast("string")
    for alias in reversed(aliases):
        hit = F.lit(False)
        for text in alias.match:
            hit = hit | path.contains(text)
        named = F.when(hit, F.lit(alias.name)).otherwise(named)
    worktree = F.nullif(F.regexp_extract(path, WORKTREE, 1), F.lit(""))
    base = F.regexp_extract(path, r"([^/]*)/?\z", 1)
    return F.when(cwd.isNull() | (cwd == ""), F.lit("Unknown Project")).otherwise(F.coalesce(named, worktree, base))


def provider_project(provider: Column, cwd: Column, aliases: Sequence[ProjectAlias] = ()) -> Column:
    """Project of a record; without a directory it is named after the provider."""
    return (F.when(cwd.isNotNull() & (cwd != ""), project_name(cwd, aliases))
            .when(provider == "claude", "Claude Code").when(provider == "cursor", "Cursor")
            .otherwise("Unknown Project"))
