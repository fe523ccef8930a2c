"""Normalization and interactions of logs while they are written, as stateful streaming.

Records (:func:`live_records`).  Lines of a file carry where they begin and where the next one does, so whatever order they arrive in, a file's state
knows the next line: it waits for it, keeps lines that came early, and hands out line numbers and the session id, directory and turn in force.  A
gap that stays open for ``delay`` is given up: the lines after it go out without it.  Lines that come for a gap given up, or twice, are late:
they go out with ``late`` set, without a number, and the tables leave them out.

Interactions (:func:`live_interactions`).  A session's state holds the records of its open interactions.  An interaction closes when the watermark passes
the instant of the boundary after it, or ``idle`` after its own last record, and its records leave the state.  Rows older than the watermark are late
and drop; rows without an instant count while their interaction is open.

A file's state that nobody has touched for ``ttl`` goes.  Both need the RocksDB state store, which :func:`use_state_store` sets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from logloom.functions.times import parse_ts
from logloom.operators.interactions import interaction_events
from logloom.operators.context import SESSION
from logloom.schema import Corpus
from logloom.session import ship_package
from logloom.sources.codex import codex_tables, extract_codex, turn_set
from logloom.sources.lines import is_blank, session_id_from_path

DAY = 86_400_000


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- records

CARRIED = "file_path string, epoch bigint, line bigint, late boolean, sid string, scwd string, cur_turn string, record string"


class CarryProcessor(StatefulProcessor):
    """Numbers a file's lines in order and carries its state over them."""

    def __init__(self, delay: int, ttl: int):
        self.delay, self.ttl = delay, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, line long, sid string, cwd string, turn string", self.ttl)
        self.early = handle.getMapState("early", "start long", "row string", self.ttl)

    def _take(self, key: tuple, given_up: bool) -> Iterator[pd.DataFrame]:
        """Everything that can go out now, in order."""
        state = self.at.get() if self.at.exists() else (0, 0, None, None, None)
        waiting = {k[0]: json.loads(v[0]) for k, v in self.early.iterator()} if self.early.exists() else {}
        out, (expected, line, *carried) = [], state
        for start in sorted(waiting):
            row = waiting[start]
            if start > expected and not given_up:
                break
            self.early.removeKey((start,))
            late = start < expected
            if not late:
                expected, line = row["end"], line + 1
                carried = [row[name] if row[name] is not None else old for name, old in zip(("sid", "cwd", "turn"), carried)]
            if not row["blank"]:
                out.append((*key, None if late else line, late, *carried, row["record"]))
        self.at.update((expected, line, *carried))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if out:
            frame = pd.DataFrame(out, columns=["file_path", "epoch", "line", "late", "sid", "scwd", "cur_turn", "record"])
            yield frame.astype({"line": "Int64", "late": bool})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        late = []
        expected = self.at.get()[0] if self.at.exists() else 0
        for batch in rows:
            for start, end, blank, sid, cwd, turn, record in batch[["byte_start", "byte_end", "blank", "sid", "cwd", "turn", "record"]].itertuples(index=False, name=None):
                row = {"end": int(end), "blank": bool(blank), "sid": sid, "cwd": cwd, "turn": turn, "record": record}
                if start < expected:
                    late.append((*key, None, True, None, None, None, record))
                else:
                    self.early.updateValue((int(start),), (json.dumps(row),))
        yield from self._take(key, False)
        if self.early.exists() and next(iter(self.early.keys()), None) is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay)
        if late:
            frame = pd.DataFrame(late, columns=["file_path", "epoch", "line", "late", "sid", "scwd", "cur_turn", "record"])
            yield frame.astype({"line": "Int64", "late": bool})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._take(key, True)

    def close(self) -> None:
        pass


def live_records(lines: DataFrame, delay_ms: int = 600_000, ttl_ms: int = 30 * DAY) -> DataFrame:
    """A stream of carried rollout records, one per non-blank line, from a stream of (file_path, epoch, byte_start, byte_end, value).

    :func:`record_tables` makes the record tables of it, as a stream or from where it was written.
    """
    spark = lines.sparkSession
    ship_package(spark)
    use_state_store(spark)
    places = ("epoch", "byte_start", "byte_end", "blank")
    base = lines.withColumns({"blank": is_blank(F.col("value")), "chunk": F.col("byte_start"), "line": F.lit(None).cast("bigint")})
    found = extract_codex(base, places)
    schema = StructType([f for f in found.schema.fields if f.name not in places])
    record = F.struct(*[c for c in found.columns if c not in places])
    packed = found.select(
        *places, "file_path", F.col("sid_set").alias("sid"), F.to_json("cwd_set").alias("cwd"), turn_set().alias("turn"),
        F.to_json(record).alias("record"))
    carried = packed.groupBy("file_path", "epoch").transformWithStateInPandas(
        statefulProcessor=CarryProcessor(delay_ms, ttl_ms), outputStructType=CARRIED, outputMode="Append", timeMode="ProcessingTime")
    opened = carried.withColumn("r", F.from_json("record", schema)).select("epoch", "late", F.col("line").alias("_line"), "sid", "scwd", "cur_turn", "r.*")
    return opened.select(
        "epoch", "late", *[c for c in schema.fieldNames() if c != "line"], F.col("_line").alias("line"), "sid",
        F.from_json("scwd", schema["cwd_set"].dataType).alias("scwd"), "cur_turn").withColumn(
        "session_id", F.coalesce("sid", session_id_from_path(F.col("file_path"))))


def record_tables(records: DataFrame, line_counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Record tables of :func:`live_records`.  Of a stream, all that are row by row; ``files`` and ``task_timings`` sum up whole files and need written
    records and (file_path, line_count)."""
    counts = records.select("file_path", "line").withColumnRenamed("line", "line_count") if line_counts is None else line_counts
    tables = codex_tables(records.filter(~F.col("late")), counts)
    return tables if line_counts is not None else {n: df for n, df in tables.items() if n not in ("files", "task_timings")}


# --- interactions

INTERACTION = ("file_path string, session_id string, line bigint, turn_id string, timestamp string, prompt string, assistant_messages bigint, context_messages bigint, "
               "tool_events bigint, token_events bigint, last_response string, usage string")
EVENT = ["line", "seq", "rank", "kind", "turn_id", "timestamp", "content", "display", "usage", "ms"]


class InteractionProcessor(StatefulProcessor):
    """Collects a session's records under the boundary before them and closes what is complete."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", ", ".join(f"{c} {'long' if c in ('line', 'seq', 'rank', 'ms') else 'string'}" for c in EVENT))

    def _fold(self, key: tuple, prompt: tuple, inside: list[tuple]) -> tuple:
        e = {name: i for i, name in enumerate(EVENT)}
        seen, counts, response, usage = set(), dict.fromkeys(("assistant", "context", "tool", "tokens"), 0), None, None
        for row in inside:
            kind = row[e["kind"]]
            if kind in ("assistant", "context"):
                if (kind, row[e["display"]]) in seen:
                    continue
                seen.add((kind, row[e["display"]]))
            counts[kind] += 1
            if kind == "assistant":
                response = row[e["content"]]
            elif kind == "tokens":
                usage = row[e["usage"]]
        return (*key, prompt[0], prompt[e["turn_id"]], prompt[e["timestamp"]], prompt[e["content"]], *counts.values(), response, usage)

    def _close(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        rows = sorted((tuple(r) for r in self.events.get()), key=lambda r: (r[0], r[2], r[1])) if self.events.exists() else []
        out, kept, next_timer = [], rows, None
        while kept:
            # The records up to the next boundary's line, under the boundary that stands before them.
            first = kept[0]
            head = first if first[3] in ("prompt", "automation") else None
            after = next((i for i, r in enumerate(kept) if r[3] in ("prompt", "automation") and r is not head), None)
            group = kept if after is None else kept[:after]
            latest = max((r[9] for r in group if r[9] is not None), default=None)
            ends = kept[after][9] if after is not None and kept[after][9] is not None else None if latest is None else latest + self.idle
            if ends is None or ends > watermark:
                next_timer = ends
                break
            if head is not None and head[3] == "prompt":
                # Records on a boundary's own line belong to no interval.
                out.append(self._fold(key, head, [r for r in group if r[0] > head[0]]))
            kept = [] if after is None else kept[after:]
        self.events.put(kept) if kept else self.events.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if next_timer is not None:
            self.handle.registerTimer(max(next_timer, watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in INTERACTION.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = []
        for batch in rows:
            for row in batch[EVENT].astype(object).where(batch[EVENT].notna(), None).itertuples(index=False, name=None):
                fresh.append(tuple(int(v) if v is not None and EVENT[i] in ("line", "seq", "rank", "ms") else v for i, v in enumerate(row)))
        if fresh:
            self.events.appendList(fresh)
        yield from self._close(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._close(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_interactions(corpus: Corpus, delay: str = "10 minutes", idle_ms: int = DAY) -> DataFrame:
    """A stream of closed interactions from streaming messages, tool events and token events; the columns are those of
    :func:`logloom.operators.interactions.interactions` without timings, which come at the end of a turn and are joined by turn id."""
    spark = corpus.spark
    ship_package(spark)
    use_state_store(spark)
    events = interaction_events(corpus).withColumns({"ts": parse_ts(F.col("timestamp")), "usage": F.to_json("usage")})
    # The state holds texts only where an interaction shows them: prompts and responses.
    events = events.withColumns({"content": F.when(F.col("kind").isin("prompt", "assistant"), F.col("content")), "display": F.sha2("display", 256)})
    timed = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)
    closed = timed.select(*SESSION, "ts", *EVENT).groupBy(*SESSION).transformWithStateInPandas(
        statefulProcessor=InteractionProcessor(idle_ms), outputStructType=INTERACTION, outputMode="Append", timeMode="EventTime")
    return closed.withColumn("usage", F.from_json("usage", corpus.token_usage.schema["usage"].dataType))
