"""Logs that grow: byte ranges, resumed parsing, the versioned cache, and the stream of added lines."""

import json
import os
import random
from collections import Counter

import pytest
from conftest import at, rows

from logloom import load_corpus
from logloom.operators import refresh, snapshots
from logloom.schema import TABLES
from logloom.sources import ranges
from logloom.streaming.growth import GrowingLinesReader, growing_lines
from logloom.streaming.live import live_token_buckets, refresh_stream


def split_like_text_source(data):
    return data.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").replace(b"\r", b"\n").removesuffix(b"\n").split(b"\n") if data else []


def test_every_cut_gives_every_line_once(tmp_path, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(ranges, "BLOCK", 7)
    for trial in range(60):
        data = b"".join(rng.choice([b"ab", b"\n", b"\r\n", b"x" * 20, "é".encode(), b"\r"]) for _ in range(rng.randrange(1, 40)))
        data = (b"\xef\xbb\xbf" if trial % 5 == 0 else b"") + data.replace(b"\r\r", b"\r")
        path = tmp_path / f"{trial}.jsonl"
        path.write_bytes(data)
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
        file = ranges.open_file(str(path))
        got = [x for a, b in zip(cuts, cuts[1:]) for x in ranges.lines_in(file, a, b, rest=b == len(data))]
        assert got == split_like_text_source(data), data


def codex_lines(rng, n, start):
    out = []
    for i in range(start, start + n):
        kind = rng.randrange(9)
        when, ev = at(i), lambda t, **p: json.dumps({"timestamp": at(i), "type": t, "payload": p})  # noqa: E731, B023
        turn = rng.choice([None, f"t{rng.randrange(6)}"])
        out.append([
            lambda: ev("session_meta", id=f"S{rng.randrange(3)}", cwd=rng.choice([None, "/w/a", "/w/b"]), timestamp=when),
            lambda: ev("turn_context", turn_id=turn, model="m", cwd=None),
            lambda: ev("event_msg", type="user_message", message=f"prompt {i} é"),
            lambda: ev("event_msg", type="agent_message", message=f"answer {i}"),
            lambda: ev("event_msg", type="task_started", turn_id=turn, started_at=rng.choice([None, i])),
            lambda: ev("event_msg", type="task_complete", turn_id=turn, duration_ms=rng.choice([None, i]), last_agent_message=rng.choice([None, "done"])),
            lambda: ev("event_msg", type="token_count", info={"last_token_usage": {"input_tokens": i, "total_tokens": i}}),
            lambda: rng.choice(["", "   ", "{broken", json.dumps({"type": "alien", "x": i})]),
            lambda: ev("event_msg", type="exec_command_end", call_id=f"c{i}", exit_code=0),
        ][kind]())
    return out


def claude_lines(rng, n, start):
    out = []
    for i in range(start, start + n):
        sid = rng.choice([None, "C1", "C2"])
        out.append(rng.choice([
            json.dumps({"type": "user", "uuid": f"u{i}", "sessionId": sid, "cwd": rng.choice([None, "/w/c"]), "timestamp": at(i), "message": {"role": "user", "content": f"ask {i}"}}),
            json.dumps({"type": "assistant", "sessionId": sid, "timestamp": at(i), "message": {"role": "assistant", "model": "m", "content": [{"type": "tool_use", "id": f"x{i}", "name": "n", "input": {}}], "usage": {"input_tokens": i}}}),
            json.dumps({"type": "summary", "summary": f"title {i}"}), "", "{broken", json.dumps({"type": "odd", "sessionId": sid})]))
    return out


def content(corpus):
    return {name: Counter(map(str, df.collect())) for name, df in corpus.tables().items()}


def append(path, lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join(lines) + end)


def test_resumed_parsing_equals_parsing_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 700)  # several ranges a file
    rng, root, cache = random.Random(6), str(tmp_path / "in"), str(tmp_path / "cache")
    paths = [f"{root}/a.jsonl", f"{root}/b.jsonl", f"{root}/.claude/projects/p/c.jsonl", f"{root}/sub/d.jsonl"]
    made = [codex_lines, codex_lines, claude_lines, claude_lines]
    append(paths[0], ['{"timestamp": "' + at(0) + '", "type": "session_meta", "payload": {"id": "S0", "cwd": "/w/z"}}'])
    append(paths[2], ["{broken"])  # no record yet: one bare session, which goes when records come
    append(paths[3], [json.dumps({"type": "user", "uuid": "u", "message": {"role": "user", "content": "first"}})])
    for step in range(3):
        for path, lines in zip(paths, made):
            if step < 2 or path != paths[1]:
                append(path, lines(rng, 12, 20 * step))
        corpus, counts = refresh.refresh_corpus(spark, cache, [root])
    assert content(corpus) == content(load_corpus(spark, [root]))
    assert tuple(counts.collect()[0]) == (1, 3, 0, 4, "updated")
    files = {os.path.basename(r.file_path): (r.base_load, r.last_load) for r in snapshots.manifest(spark, cache, snapshots.snapshot(spark, cache)).collect()}
    assert files == {"a.jsonl": (1, 3), "b.jsonl": (1, 2), "c.jsonl": (1, 3), "d.jsonl": (1, 3)}
    # An unfinished line, a replaced file of a greater length, a shorter one and a removed one are parsed from the start.
    append(paths[0], ['{"timestamp": "x", "type": "event_msg", "payl'], end="")
    with open(paths[1], "w", encoding="utf-8") as f:
        f.write("\n".join(codex_lines(rng, 60, 100)) + "\n")
    with open(paths[2], "w", encoding="utf-8") as f:
        f.write("\n".join(claude_lines(rng, 3, 200)) + "\n")
    os.remove(paths[3])
    corpus, _ = refresh.refresh_corpus(spark, cache, [root])
    assert content(corpus) == content(load_corpus(spark, [root]))
    append(paths[0], ['oad": {"type": "agent_message", "message": "whole now"}}'])
    corpus, _ = refresh.refresh_corpus(spark, cache, [root])
    assert content(corpus) == content(load_corpus(spark, [root]))
    assert not corpus.messages.filter("content = 'whole now'").isEmpty()


def test_snapshots_compaction_and_vacuum(spark, tmp_path):
    rng, root, cache = random.Random(9), str(tmp_path / "in"), str(tmp_path / "cache")
    append(f"{root}/a.jsonl", codex_lines(rng, 20, 0))
    append(f"{root}/b.jsonl", codex_lines(rng, 20, 50))
    refresh.refresh_corpus(spark, cache, [root])

    def data():
        return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(f"{cache}/data") for x in names}

    first, before = data(), refresh.read_cache(spark, cache)
    known = content(before)
    append(f"{root}/a.jsonl", codex_lines(rng, 10, 100))
    os.remove(f"{root}/b.jsonl")
    refresh.refresh_corpus(spark, cache, [root])
    assert first.items() <= data().items()  # no older file was touched
    assert content(before) == known == content(refresh.read_cache(spark, cache, 1))  # the reader stays on its snapshot
    now = content(refresh.read_cache(spark, cache))
    assert now == content(load_corpus(spark, [root])) and snapshots.snapshot(spark, cache).dirty == (1,)
    compacted = snapshots.compact(spark, cache)
    assert compacted.loads == (3,) and not compacted.dirty and content(refresh.read_cache(spark, cache)) == now
    assert snapshots.vacuum(spark, cache, keep=1) == [1, 2] and content(refresh.read_cache(spark, cache)) == now
    assert sorted(os.listdir(f"{cache}/data/messages")) == ["load=3"] and snapshots.versions(spark, cache) == [3]
    append(f"{root}/a.jsonl", codex_lines(rng, 10, 200))
    refresh.refresh_corpus(spark, cache, [root])
    assert content(refresh.read_cache(spark, cache)) == content(load_corpus(spark, [root])) and snapshots.snapshot(spark, cache).loads == (3, 4)
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.commit(spark, cache, snapshots.Snapshot(4, (4,)))


def test_growing_files_stream(spark, tmp_path):
    root, listings, check, out = (str(tmp_path / n) for n in ("in", "listings", "check", "out"))
    os.makedirs(root)

    def run():
        lines = growing_lines(spark, [root], listings)
        (lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
         .trigger(availableNow=True).start()).awaitTermination(120)
        return sorted(rows(spark.read.parquet(out), "file_path", "epoch", "value"))

    a, b = f"{root}/a.jsonl", f"{root}/deep/.hidden/b.jsonl"
    append(a, ["one", "two"])
    first = [(a, 0, "one"), (a, 0, "two")]
    assert run() == first
    assert run() == first  # nothing new
    append(a, ["three", "unfini"], end="")
    append(b, ["été"])
    second = sorted([*first, (a, 0, "three"), (b, 0, "été")])
    assert run() == second
    append(a, ["shed"])
    third = sorted([*second, (a, 0, "unfinished")])
    assert run() == third
    with open(a, "w") as f:
        f.write("anew\n")
    assert run() == sorted([*third, (a, 1, "anew")])


def test_listing_offsets_repeat_after_a_restart(tmp_path):
    root, listings = str(tmp_path / "in"), str(tmp_path / "l")
    append(f"{root}/a.jsonl", ["1"])
    reader = GrowingLinesReader([root], listings)
    one = reader.latestOffset()
    append(f"{root}/a.jsonl", ["2"])
    two = GrowingLinesReader([root], listings).latestOffset()
    fresh = GrowingLinesReader([root], listings)
    assert (one, two) == ({"listing": 1}, {"listing": 2}) == (one, fresh.latestOffset())
    values = [v for p in fresh.partitions(one, two) for batch in fresh.read(p) for v in batch.column(4).to_pylist()]
    assert values == ["2"]
    fresh.commit(two)
    assert os.listdir(listings) == ["2.parquet"]


def test_refresh_stream_sees_growth(spark, tmp_path):
    rng, root, cache, check = random.Random(1), str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "check")
    append(f"{root}/a.jsonl", codex_lines(rng, 10, 0))
    refresh_stream(spark, root, cache, check).awaitTermination(120)
    append(f"{root}/a.jsonl", codex_lines(rng, 10, 30))
    refresh_stream(spark, root, cache, check).awaitTermination(120)
    assert content(refresh.read_cache(spark, cache)) == content(load_corpus(spark, [root]))


def test_live_buckets_are_appended_and_leave_the_state(spark, tmp_path):
    from logloom.schema import USAGE_FIELDS

    usage = ", ".join(f"cast(1 as bigint) as {n}" for n in USAGE_FIELDS)

    def put(n, *times):
        values = ", ".join(f"(timestamp'{t}')" for t in times)
        spark.sql(f"SELECT 'f' AS file_path, cast(ts AS string) AS timestamp, 't' AS turn_id, ts, struct({usage}) AS usage FROM VALUES {values} AS v(ts)").write.parquet(f"{tmp_path}/in/{n}")

    put(1, "2026-01-01T01:00:00Z", "2026-01-01T02:00:00Z")
    schema = spark.read.parquet(f"{tmp_path}/in/1").schema

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = (live_token_buckets(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
                 .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
        query.awaitTermination(120)
        return sorted(rows(spark.read.parquet(f"{tmp_path}/out"), "bucket", "total_tokens")), query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert run()[0] == []
    put(2, "2026-01-03T01:00:00Z")
    got, _ = run()
    assert got == [("2026-01-01", 2)]
    put(3, "2026-01-01T05:00:00Z", "2026-01-05T01:00:00Z")  # the first is late and drops
    got, state = run()
    assert got == [("2026-01-01", 2), ("2026-01-03", 1)] and state == 1
