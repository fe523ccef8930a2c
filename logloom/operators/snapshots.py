"""A versioned cache of record tables: immutable loads, and snapshots that say which rows of them live.

Every load adds files of rows and never touches older ones.  A snapshot is a small JSON file with the loads it reads, beside a manifest with one row
per log file: the load it was last parsed from the start in (``base_load``), the one that last added to it (``last_load``), and the scan state at its
end.  A row lives if its load is not older than its file's ``base_load``, so replaced and removed files are dropped on reading, by a join that only loads
with dead rows need.  Records that describe a whole file, session or turn are merged on reading.  ``compact`` writes the living rows as one load,
``vacuum`` deletes what no kept snapshot reads; until then a reader finishes on the snapshot it began with.

The folder holds ``snapshots/<version>.json``, ``manifest/<version>/`` and ``data/<table>/load=<load>/``.  A version is claimed by creating its
JSON file, which fails if another writer was first.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.schema import TABLE_DDL, TABLES, Corpus, corpus_from_tables

PARSER_VERSION = "1"
MANIFEST_DDL = ("file_path string, size bigint, modified timestamp, parser_version string, kind string, provider string, line_count bigint, seen boolean, "
                "tail bigint, terminated boolean, base_load bigint, last_load bigint, sid string, cwd struct<x: string>, turn string, title string")
#: What the cache keeps besides a table's own columns.
EXTRA = {"task_timings": ", has_start boolean, has_end boolean"}


@dataclass(frozen=True)
class Snapshot:
    """Version, the loads it reads, and those of them that hold rows which no longer live."""

    version: int = 0
    loads: tuple[int, ...] = ()
    dirty: tuple[int, ...] = ()


def cache_schema(name: str) -> StructType:
    return StructType.fromDDL(TABLE_DDL[name] + EXTRA.get(name, ""))


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, cache: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{cache}/snapshots") if n.removesuffix(".json").isdigit() and n.endswith(".json"))


def snapshot(spark: SparkSession, cache: str, version: int | None = None) -> Snapshot:
    """The named or the latest snapshot; an empty one if there is none."""
    known = versions(spark, cache)
    if not known:
        return Snapshot()
    text = "".join(r[0] for r in spark.read.text(f"{cache}/snapshots/{known[-1] if version is None else version}.json", wholetext=True).collect())
    stored = json.loads(text)
    return Snapshot(stored["version"], tuple(stored["loads"]), tuple(stored["dirty"]))


def commit(spark: SparkSession, cache: str, new: Snapshot) -> None:
    """Publish a snapshot; fails if its version exists."""
    fs, where = _fs(spark, f"{cache}/snapshots/{new.version}.json")
    out = fs.create(where, False)
    out.write(json.dumps(asdict(new)).encode())
    out.close()


def manifest(spark: SparkSession, cache: str, at: Snapshot) -> DataFrame:
    if not at.version:
        return spark.createDataFrame([], MANIFEST_DDL)
    return spark.read.schema(MANIFEST_DDL).parquet(f"{cache}/manifest/{at.version}")


def write_load(spark: SparkSession, cache: str, load: int, tables: dict[str, DataFrame]) -> None:
    """Add one load; small outputs are put together and large ones split before they are written.  The tables' jobs run side by side."""
    def write(name: str) -> None:
        have, schema = set(tables[name].columns), cache_schema(name)
        rows = tables[name].select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        rows.hint("rebalance").write.mode("overwrite").parquet(f"{cache}/data/{name}/load={load}")

    with ThreadPoolExecutor(len(TABLES)) as pool:
        list(pool.map(write, TABLES))


def _rows(spark: SparkSession, cache: str, name: str, at: Snapshot, files: DataFrame) -> DataFrame:
    """Living rows of a table with their load."""
    schema = cache_schema(name).add("load", "long")

    def read(loads):
        return spark.read.schema(schema).option("basePath", f"{cache}/data/{name}").parquet(*[f"{cache}/data/{name}/load={n}" for n in loads])

    if not at.loads:
        return spark.createDataFrame([], schema)
    if name == "files":  # the last load has the row of the whole file
        last = files.select(F.col("file_path").alias("_f"), "last_load")
        return read(at.loads).join(last, (F.col("file_path") == F.col("_f")) & (F.col("load") == F.col("last_load")), "left_semi")
    clean = [n for n in at.loads if n not in at.dirty]
    parts = [read(clean)] if clean else []
    if at.dirty:
        base = files.select(F.col("file_path").alias("_f"), "base_load")
        parts.append(read(at.dirty).join(base, (F.col("file_path") == F.col("_f")) & (F.col("load") >= F.col("base_load")), "left_semi"))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def _merged_timings(rows: DataFrame) -> DataFrame:
    """One row per file and turn: what each load saw last replaces what older loads saw."""
    same = ["provider", "input_kind", "source_label", "title", "provider_conversation_id"]
    end = F.struct("completed_at", "duration_ms", "time_to_first_token_ms", "last_agent_message")
    out = rows.groupBy("file_path", "turn_id").agg(
        *[F.min_by(c, "load").alias(c) for c in [*same, "session_id"]],
        F.max_by(F.struct("started_at"), F.when(F.col("has_start"), F.col("load"))).alias("s"), F.max_by(end, F.when(F.col("has_end"), F.col("load"))).alias("d"))
    return out.select(*same, "file_path", "session_id", "turn_id", "s.started_at", "d.*", F.col("s").isNotNull().alias("has_start"), F.col("d").isNotNull().alias("has_end"))


def _merged_sessions(rows: DataFrame) -> DataFrame:
    """Claude sessions are one row per file and session: the earliest of each field; a file's row without a record goes once records have come."""
    mine = F.coalesce(F.col("provider") == "claude", F.lit(False))
    columns = [c for c in rows.columns if c != "load"]
    claude = rows.filter(mine)
    per = claude.groupBy("file_path", "session_id").agg(*[
        (F.min_by(F.struct(c), "load")[c] if c in ("line", "timestamp") else F.min_by(c, F.when(F.col(c).isNotNull(), F.col("load")))).alias(c)
        for c in columns if c not in ("file_path", "session_id")])
    recorded = claude.filter("line > 0").select("file_path").distinct()
    bare = per.filter("line = 0").join(recorded, "file_path", "left_anti")
    return rows.filter(~mine).select(columns).unionAll(per.filter("line > 0").unionAll(bare).select(columns))


def living(spark: SparkSession, cache: str, at: Snapshot) -> dict[str, DataFrame]:
    """All tables of a snapshot, merged, with the cache's extra columns."""
    files = manifest(spark, cache, at)
    tables = {name: _rows(spark, cache, name, at, files) for name in TABLES}
    tables["task_timings"] = _merged_timings(tables["task_timings"])
    tables["sessions"] = _merged_sessions(tables["sessions"])
    return tables


def read_snapshot(spark: SparkSession, cache: str, version: int | None = None) -> Corpus:
    """The corpus of the named or the latest snapshot."""
    return corpus_from_tables(spark, living(spark, cache, snapshot(spark, cache, version)))


def dead_loads(gone: DataFrame) -> list[int]:
    """Loads that hold rows of files which a new load replaces or removes; as many numbers as there are loads at most."""
    loads = gone.select(F.explode(F.sequence("base_load", "last_load")).alias("load")).distinct()
    return [r[0] for r in loads.collect()]


def live_loads(files: DataFrame) -> list[int]:
    """Loads that some file of a manifest has rows in."""
    return [r[0] for r in files.select(F.explode(F.sequence("base_load", "last_load")).alias("load")).distinct().collect()]


def compact(spark: SparkSession, cache: str) -> Snapshot:
    """Write all living rows as one load, in a job of its own; older snapshots stay readable."""
    at = snapshot(spark, cache)
    load = at.version + 1
    write_load(spark, cache, load, living(spark, cache, at))
    number = F.lit(load).cast("bigint")
    manifest(spark, cache, at).withColumns({"base_load": number, "last_load": number}).write.mode("overwrite").parquet(f"{cache}/manifest/{load}")
    new = Snapshot(load, (load,), ())
    commit(spark, cache, new)
    return new


def vacuum(spark: SparkSession, cache: str, keep: int = 2) -> list[int]:
    """Delete what none of the last ``keep`` snapshots reads; returns the deleted loads."""
    known = versions(spark, cache)
    kept = known[-keep:]
    used = {n for v in kept for n in snapshot(spark, cache, v).loads}
    gone = set()
    for name in TABLES:
        for folder in _names(spark, f"{cache}/data/{name}"):
            load = int(folder.removeprefix("load="))
            if load not in used and load <= known[-1]:  # a later one is being written
                gone.add(load)
                fs, where = _fs(spark, f"{cache}/data/{name}/{folder}")
                fs.delete(where, True)
    for version in known[:-keep]:
        for path in (f"{cache}/snapshots/{version}.json", f"{cache}/manifest/{version}"):
            fs, where = _fs(spark, path)
            fs.delete(where, True)
    return sorted(gone)
