"""Loading log files of all providers into one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schema import Corpus, corpus_from_tables, union_corpora
from logloom.session import stage_table
from logloom.sources.claude import normalize_claude
from logloom.sources.codex import normalize_codex
from logloom.sources.cursor import normalize_cursor_kv, normalize_cursor_markdown, read_vscdb, storage_dir
from logloom.sources.discovery import effective_provider, existing_roots, found_paths, log_files, spark_roots
from logloom.sources.lines import CLAUDE_PATH, plain_path, read_lines
from logloom.sources.ranges import ranged, read_added


def only_provider(corpus: Corpus, provider: str) -> Corpus:
    if provider == "all":
        return corpus
    return corpus.map(lambda _, df: df.filter(F.col("provider") == provider))


def _input(kind: str, roots: list[str], files: DataFrame, subset: bool) -> tuple[list[str], dict]:
    """What Spark's readers open: the roots searched recursively, or the named files of a subset."""
    if subset:
        return [r[0] for r in files.filter(F.col("kind") == kind).select("file_path").orderBy("file_path").toLocalIterator()], {}
    return roots, {"recursiveFileLookup": "true", "pathGlobFilter": f"*.{kind}"}


def _log_lines(spark: SparkSession, logs: DataFrame, others: list[str], subset: bool) -> tuple[DataFrame, DataFrame]:
    """Lines of the JSON line files, and (file_path, line_count, provider) of each: tasks open those they can, Spark's reader the rest."""
    by_range = ranged(F.col("file_path"))
    none = F.lit(0).cast("bigint")
    lines, listed = read_added(logs.filter(by_range).select("file_path", none.alias("start"), "size", none.alias("first_line"), F.lit(None).cast("string").alias("provider")))
    lines, listed = stage_table(lines, "provider"), listed.select("file_path", "line_count", "provider")
    rest = logs.filter(~by_range)
    opened, options = _input("jsonl", others, rest, subset)
    if opened and not rest.isEmpty():
        more = stage_table(read_lines(spark, opened, options).join(rest.select("file_path"), "file_path", "left_semi"), "provider")
        counts = more.groupBy("file_path", "provider").agg(F.max("line").alias("line_count"))
        named = F.coalesce("provider", F.when(F.col("file_path").contains(CLAUDE_PATH), "claude").otherwise("codex"))
        listed = listed.unionByName(rest.select("file_path").join(counts, "file_path", "left").select(
            "file_path", F.coalesce("line_count", F.lit(0)).alias("line_count"), named.alias("provider")))
        lines = lines.unionByName(more)
    return lines, stage_table(listed)


def _store_roots(files: DataFrame) -> list[str]:
    """The folders of chat stores, one each: Spark's reader lists no dot folders by itself."""
    folder = F.regexp_extract("file_path", r"\A(.*)/[^/]*\z", 1)
    return [r[0] for r in files.select(folder.alias("f")).distinct().toLocalIterator()]


def load_corpus(spark: SparkSession, paths: list[str] | None = None, provider: str | None = None,
                home: str = "~", subset: DataFrame | None = None) -> Corpus:
    """Parse every log below ``paths``; the provider filter applies after detection.

    ``subset`` (rows of :func:`log_files`) restricts the load to those files.
    """
    provider = effective_provider(paths, provider)
    files = stage_table(log_files(spark, paths, provider, home)) if subset is None else subset
    others = spark_roots(spark, existing_roots(paths, provider, home))
    kinds = {r[0] for r in files.select("kind").distinct().collect()}  # at most three values
    parts = []
    if "jsonl" in kinds:
        lines, listed = _log_lines(spark, files.filter(F.col("kind") == "jsonl"), others, subset is not None)
        for name, build in (("codex", normalize_codex), ("claude", normalize_claude)):
            if provider in ("all", name):
                parts.append(build(lines.filter(F.col("provider") == name).drop("provider"),
                                   listed.filter(F.col("provider") == name).drop("provider")))
    if "vscdb" in kinds:
        held = files.filter(F.col("kind") == "vscdb").select("file_path")
        stores = spark.read.format("binaryFile").option("pathGlobFilter", "*.vscdb").load(_store_roots(held))
        stores = stores.withColumn("file_path", plain_path(F.col("path"))).join(held, "file_path", "left_semi")
        parts.append(normalize_cursor_kv(stage_table(read_vscdb(stores)), _workspaces(spark, files)))
    if "md" in kinds:
        opened, _ = _input("md", [], files, True)
        parts.append(normalize_cursor_markdown(read_lines(spark, opened).drop("provider")))
    corpus = union_corpora(parts) if parts else corpus_from_tables(spark, {})
    return only_provider(corpus, provider)


def _workspaces(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, value) of the ``workspace.json`` files beside the state files."""
    roots = [r[0] for r in files.filter(F.col("kind") == "vscdb").select(
        storage_dir(F.col("file_path")).alias("d")).filter("d IS NOT NULL").distinct().toLocalIterator()]
    named = found_paths(spark, [f"{r}/workspaceStorage/*/workspace.json" for r in roots])
    if not named:
        return spark.createDataFrame([], "path string, value string")
    found = spark.read.text(named, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), "value")
