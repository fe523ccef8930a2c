"""Which files are logs."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.lines import plain_path
from logloom.sources.ranges import listable
from logloom.sources.walk import walk

# Log folders below a home directory, and folders never searched.
DEFAULT_ROOTS = {
    "codex": [".codex/sessions", ".codex/archived_sessions"],
    "claude": [".claude/projects"],
    "cursor": [
        "Library/Application Support/Cursor/User/globalStorage/state.vscdb",
        "Library/Application Support/Cursor - Insiders/User/globalStorage/state.vscdb",
    ],
}
IGNORED = r"/(node_modules|\.git)/"
GLOBAL_STATE = r"/User/globalStorage/state\.vscdb\z"


def default_log_roots(provider: str = "codex", home: str = "~") -> list[str]:
    home = os.path.expanduser(home)
    names = list(DEFAULT_ROOTS) if provider == "all" else [provider if provider in DEFAULT_ROOTS else "codex"]
    return [f"{home}/{root}" for name in names for root in DEFAULT_ROOTS[name]]


def effective_provider(paths: list[str] | None, provider: str | None) -> str:
    return provider or ("all" if paths else "codex")


def found_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """What exists of some path patterns, in any file system; patterns may name folders that start with a dot."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        hits = path.getFileSystem(conf).globStatus(path)
        out += [x.getPath().toString() for x in hits] if hits is not None else []
    return out


def existing_roots(paths: list[str] | None, provider: str, home: str = "~") -> list[str]:
    """Input roots as paths or URIs; local ones that do not exist are left out."""
    roots = [re.sub(r"\Afile:/+", "/", p).rstrip("/") or "/" for p in (paths or default_log_roots(provider, home))]
    local = [r for r in roots if "://" not in r and os.path.exists(r)]
    return list(dict.fromkeys([os.path.abspath(r) for r in local] + [r for r in roots if "://" in r]))


def spark_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """Those roots that only Spark can list.

    Spark skips folders whose name starts with a dot, so the tools' own dot folders in such a root, in its folders (a home
    per user) or one level below are roots themselves.  Other dot folders there have to be named.
    """
    folders = [r for r in roots if not listable(r)]
    own = DEFAULT_ROOTS["codex"] + DEFAULT_ROOTS["claude"]
    dotted = found_paths(spark, [f"{r}{below}/{sub}" for r in folders for below in ("", "/*", "/*/*") for sub in own])
    return list(dict.fromkeys(folders + dotted))


def log_files(spark: SparkSession, paths: list[str] | None = None, provider: str | None = None,
              home: str = "~") -> DataFrame:
    """(file_path, size, modified, kind) of every log file; kind is jsonl, vscdb or md.

    Folders are searched at any depth, dot folders and links to folders included (:mod:`logloom.sources.walk`); a Markdown export, or a state file
    outside its usual place, must be named itself.  Only the listing is read, never the contents.
    """
    provider = effective_provider(paths, provider)
    roots = existing_roots(paths, provider, home)
    path = F.col("file_path")
    listings = [spark.createDataFrame([], "file_path string, size bigint, modified timestamp, named boolean")]
    if own := [r for r in roots if listable(r)]:
        listings.append(walk(spark, own, (".jsonl", ".vscdb")))
    if others := spark_roots(spark, roots):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(others)
        listed = listed.select(plain_path(F.col("path")).alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        listings.append(listed.filter(~path.rlike(IGNORED)).withColumn("named", path.isin(*others)).dropDuplicates(["file_path"]))
    kind = (F.when(path.endswith(".jsonl"), "jsonl").when(path.endswith(".vscdb"), "vscdb")
            .when(path.endswith(".md"), "md"))
    wanted = ((kind == "jsonl") & F.lit(provider != "cursor")) \
        | ((kind == "vscdb") & F.lit(provider in ("all", "cursor")) & (F.col("named") | path.rlike(GLOBAL_STATE))) \
        | ((kind == "md") & F.lit(provider in ("all", "cursor")) & F.col("named"))
    return (reduce(DataFrame.unionByName, listings).withColumn("kind", kind).filter(wanted)
            .select("file_path", "size", "modified", "kind"))
