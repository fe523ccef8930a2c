"""Incremental loads: which files to reuse, parse, parse on or remove.

A log that only grew is parsed on from the byte where its last load ended, with the session id, directory, turn and title that were in force
there; its older rows stay where they are.  All else that changed is parsed from the start.  Lists of changed files are tables, joined, not
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.snapshots import (MANIFEST_DDL, PARSER_VERSION, Snapshot, commit, dead_loads, live_loads, manifest, read_snapshot, snapshot,
                                         write_load)
from logloom.schema import TABLES, Corpus, corpus_from_tables
from logloom.session import stage_table
from logloom.sources import claude, codex
from logloom.sources.corpus import load_corpus, only_provider
from logloom.sources.discovery import default_log_roots, effective_provider, log_files
from logloom.sources.lines import session_id_from_path
from logloom.sources.ranges import file_ends, ranged, read_added


def in_scope(paths: list[str]):
    """Files at or below one of the paths."""
    hit = F.lit(False)
    for p in paths:
        root = p.rstrip("/")
        hit = hit | (F.col("file_path") == root) | F.col("file_path").startswith(root + "/")
    return hit


def manifest_diff(old: DataFrame, new: DataFrame, scope=None, rebuild: bool = False,
                  parser_version: str = PARSER_VERSION) -> DataFrame:
    """(file_path, action): reuse, parse, remove, or keep for old files outside the scope.

    ``scope`` is a condition on old files (everything by default).  Old entries of another parser version are no
    entries.
    """
    scope = F.lit(True) if scope is None else scope
    old = old.filter(F.col("parser_version") == parser_version).select(
        "file_path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), scope.alias("in_scope"))
    new = new.select("file_path", "size", "modified")
    same = (F.col("old_size") == F.col("size")) & (F.col("old_modified") == F.col("modified"))
    known = F.col("old_size").isNotNull()
    found = F.col("size").isNotNull()
    action = (F.when(found & known & same & F.lit(not rebuild), "reuse").when(found, "parse")
              .when(F.col("in_scope"), "remove").otherwise("keep"))
    removed = F.when(known & F.col("in_scope") & (F.lit(rebuild) | ~found), 1).otherwise(0)
    return old.join(new, "file_path", "full_outer").select("file_path", "size", "modified", action.alias("action"),
                                                           removed.alias("removed"))


def refresh_counts(diff: DataFrame, rebuild: bool = False) -> DataFrame:
    """Reused, parsed, removed and total files, and the load status."""
    sums = diff.agg(F.count_if(F.col("action") == "reuse").alias("reused_files"),
                    F.count_if(F.col("action") == "parse").alias("parsed_files"),
                    F.coalesce(F.sum("removed"), F.lit(0)).cast("bigint").alias("removed_files"))
    status = F.lit("rebuilt") if rebuild else F.when(
        (F.col("parsed_files") > 0) | (F.col("removed_files") > 0), "updated").otherwise("ready")
    return sums.select("reused_files", "parsed_files", "removed_files",
                       (F.col("reused_files") + F.col("parsed_files")).alias("total_files"), status.alias("status"))


STATE = ["sid", "cwd", "turn", "title"]


def read_cache(spark: SparkSession, cache_dir: str, version: int | None = None) -> Corpus:
    """The cached tables of the latest snapshot, or of the named one."""
    return read_snapshot(spark, cache_dir, version)


def refresh_corpus(spark: SparkSession, cache_dir: str, paths: list[str] | None = None, provider: str | None = None,
                   home: str = "~", rebuild: bool = False) -> tuple[Corpus, DataFrame]:
    """Bring the cache up to date and return the visible corpus and the refresh counts.

    New rows are one more load of the versioned cache (:mod:`logloom.operators.snapshots`); no older data file is rewritten.
    """
    active = effective_provider(paths, provider)
    new = stage_table(log_files(spark, paths, active, home))
    at = snapshot(spark, cache_dir)
    old = manifest(spark, cache_dir, at)
    # With both paths and one provider the scope is just the discovered files, so nothing else is removed.
    roots = paths if paths else default_log_roots(active, home)
    scope = F.lit(False) if paths and provider and provider != "all" else in_scope(roots)
    diff = stage_table(manifest_diff(old, new, scope, rebuild))
    counts = refresh_counts(diff, rebuild)
    if not diff.filter(F.col("action").isin("parse", "remove")).isEmpty():
        _add_load(spark, cache_dir, at, old, new, diff, rebuild, paths, home)
    corpus = read_cache(spark, cache_dir)
    if not diff.filter("action = 'keep'").isEmpty():
        listed = new.select("file_path")
        corpus = corpus.map(lambda _, df: df.join(listed, "file_path", "left_semi"))
    return only_provider(corpus, active), counts


def _work(old: DataFrame, changed: DataFrame, rebuild: bool) -> DataFrame:
    """Changed JSON line files with where to go on from: at the old end if all up to there is still the same and ends a line, else at the start."""
    was = old.select("file_path", F.col("size").alias("old_size"), *[F.col(c).alias(f"was_{c}") for c in ("parser_version", "tail", "terminated", "seen", "line_count", "provider", "base_load", *STATE)])
    both = changed.join(was, "file_path", "left")
    both = both.join(file_ends(both), "file_path")
    grown = F.coalesce((F.col("was_parser_version") == PARSER_VERSION) & (F.col("size") > F.col("old_size")) & F.col("was_terminated") & F.col("was_seen")
                       & (F.col("before") == F.col("was_tail")) & F.lit(not rebuild), F.lit(False))
    both = both.withColumn("grown", grown)
    kept = {c: F.when(F.col("grown"), F.col(f"was_{c}")) for c in ("provider", "base_load", *STATE)}
    return both.select("file_path", "size", "modified", "kind", "tail", "terminated", "grown",
                       F.when(F.col("grown"), F.col("old_size")).otherwise(0).alias("start"), F.when(F.col("grown"), F.col("was_line_count")).otherwise(0).alias("first_line"),
                       *[c.alias(name) for name, c in kept.items()])


def _parsed(work: DataFrame) -> tuple[dict[str, list[DataFrame]], DataFrame]:
    """Tables of what was added, as parts, and (file_path, provider, line_count, seen, state) of every file."""
    lines, found = read_added(work.select("file_path", "start", "size", "first_line", "provider"))
    before = work.filter("grown").select("file_path", *STATE)
    fresh = found.join(work.filter("not grown").select("file_path"), "file_path", "left_semi")
    tables: dict[str, list[DataFrame]] = {name: [] for name in TABLES}
    states = []
    providers = {r[0] for r in found.select("provider").distinct().collect()}  # two at most
    sources = [(name, source) for name, source in (("codex", codex), ("claude", claude)) if name in providers]
    for name, source in sources:
        mine = lines.filter(F.col("provider") == name).drop("provider")
        if name == "codex":
            records = stage_table(codex.carry_codex(stage_table(codex.extract_codex(mine)), before.select(
                "file_path", "sid", F.col("cwd").alias("scwd"), F.col("turn").alias("cur_turn"))))
            carried, built = records, codex.codex_tables(records, fresh.filter("provider = 'codex'").select("file_path", "line_count"))
            ends = F.struct("sid", F.col("scwd").alias("cwd"), F.col("cur_turn").alias("turn"), F.lit(None).cast("string").alias("title"))
        else:
            records = stage_table(claude.extract_claude(mine))
            carried = stage_table(claude.carry_claude(records, before.select("file_path", "sid", F.col("cwd.x").alias("cwd"), "title")))
            built = claude.claude_tables(records, carried, fresh.filter("provider = 'claude'").select("file_path", "line_count"))
            ends = F.struct("sid", F.struct(F.col("cwd").alias("x")).alias("cwd"), F.lit(None).cast("string").alias("turn"), "title")
        states.append(carried.groupBy("file_path").agg(F.max_by(ends, "line").alias("end")))
        for table, rows in built.items():
            if table != "files":
                tables[table].append(rows)
    end = states[0] if len(states) == 1 else states[0].unionByName(states[1])
    files = found.join(end, "file_path", "left").join(before.withColumn("saved", F.struct(*STATE)).select("file_path", "saved"), "file_path", "left")
    files = stage_table(files.select("file_path", "provider", "line_count", "seen", F.coalesce("end", "saved").alias("end")).select(
        "file_path", "provider", "line_count", "seen", *[F.col(f"end.{c}").alias(c) for c in STATE]))
    for name, source in sources:
        tables["files"].append(codex.with_meta(files.filter(F.col("provider") == name).select(
            "file_path", "line_count", F.coalesce("sid", session_id_from_path(F.col("file_path"))).alias("session_id")), source.META))
    return tables, files


def _add_load(spark: SparkSession, cache_dir: str, at: Snapshot, old: DataFrame, new: DataFrame, diff: DataFrame, rebuild: bool,
              paths: list[str] | None, home: str) -> None:
    load = at.version + 1
    number = F.lit(load).cast("bigint")
    changed = new.join(diff.filter(F.col("action") == "parse").select("file_path"), "file_path", "left_semi")
    by_range = (F.col("kind") == "jsonl") & ranged(F.col("file_path"))
    whole = stage_table(changed.filter(~by_range))
    work = stage_table(_work(old, changed.filter(by_range), rebuild))
    tables: dict[str, list[DataFrame]] = {name: [] for name in TABLES}
    entries = [whole.select("file_path", "size", "modified", "kind", number.alias("base_load"))]
    if not work.isEmpty():
        tables, files = _parsed(work)
        entries.append(work.select("file_path", "size", "modified", "kind", "tail", "terminated", F.coalesce("base_load", number).alias("base_load")).join(files, "file_path"))
    if not whole.isEmpty():  # chat stores, exports, and stores that only Spark reads
        rest = load_corpus(spark, paths, "all", home, subset=whole)
        for name, rows in rest.tables().items():
            tables[name].append(rows)
    empty = corpus_from_tables(spark, {}).tables()
    unions = {}
    for name, parts in tables.items():
        out = parts[0] if parts else empty[name]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        unions[name] = out
    write_load(spark, cache_dir, load, unions)
    kept = old.join(diff.filter(F.col("action").isin("reuse", "keep")).select("file_path"), "file_path", "left_semi")
    rows = kept
    for part in entries:
        rows = rows.unionByName(part.withColumns({"parser_version": F.lit(PARSER_VERSION), "last_load": number}), allowMissingColumns=True)
    schema = spark.createDataFrame([], MANIFEST_DDL).schema
    path = f"{cache_dir}/manifest/{load}"
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").parquet(path)
    files = spark.read.schema(schema).parquet(path)
    # Rows of a file that is gone, or was parsed anew, are dead in the loads that hold them.
    replaced = old.join(files.select("file_path", F.col("base_load").alias("now")), "file_path", "left").filter("now IS NULL OR now > base_load")
    live = live_loads(files)
    dirty = sorted({*at.dirty, *dead_loads(replaced)} & set(live))
    commit(spark, cache_dir, Snapshot(load, tuple(sorted(live)), tuple(dirty)))
