"""Records and interactions of live logs against the batch tables, for shuffled arrival."""

import json
import random
from collections import Counter

from conftest import at, event, rows
from pyspark.sql import functions as F
from test_growth import append, codex_lines, content

from logloom import load_corpus
from logloom.operators import interactions
from logloom.schema import corpus_from_tables
from logloom.streaming.growth import growing_lines
from logloom.streaming.stateful import live_interactions, live_records, record_tables


def drain(stream, out, check, **trigger):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(**(trigger or {"availableNow": True})).start()
    assert query.awaitTermination(120)


def test_live_records_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    paths = [f"{tmp_path}/in/{n}.jsonl" for n in "ab"]
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    for step in range(3):
        for path in paths:
            append(path, codex_lines(rng, 15, 20 * step))
        drain(live_records(growing_lines(spark, [f"{tmp_path}/in"], f"{tmp_path}/l")), out, check)
    written = spark.read.parquet(out)
    batch = load_corpus(spark, [f"{tmp_path}/in"])
    counts = batch.files.select("file_path", "line_count")
    live = corpus_from_tables(spark, record_tables(written, counts))
    assert content(live) == content(batch) and written.filter("late").isEmpty()


def test_lines_out_of_order_and_late(spark, tmp_path):
    """Lines of one file in three batches: early ones wait, a gap is given up after the delay, and what comes for it then is late."""
    lines = [event(0, "session_meta", id="S", cwd="/w"), event(1, "event_msg", type="user_message", message="one"), event(2, "event_msg", type="agent_message", message="two"),
             event(3, "event_msg", type="agent_message", message="three"), event(4, "event_msg", type="agent_message", message="four")]
    texts, placed, start = [json.dumps(x) for x in lines], [], 0
    for text in texts:
        placed.append(("/x/f.jsonl", 0, start, start + len(text) + 1, text))
        start += len(text) + 1
    schema = "file_path string, epoch bigint, byte_start bigint, byte_end bigint, value string"

    def run(n, part, delay):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        drain(live_records(stream, delay), f"{tmp_path}/out", f"{tmp_path}/check", once=True)  # a timer keeps a query alive
        return sorted(rows(spark.read.parquet(f"{tmp_path}/out"), "line", "late", "content", "session_id"), key=str)

    assert run(1, [placed[1], placed[0]], 3_600_000) == [(1, False, None, "S"), (2, False, "one", "S")]
    assert run(2, [placed[4]], 4_000) == [(1, False, None, "S"), (2, False, "one", "S")]  # waits
    other = ("/x/g.jsonl", 0, 0, 10, json.dumps({"type": "alien"}))
    got = run(3, [other], 4_000)  # a later batch finds the delay over
    assert (3, False, "four", "S") in got
    assert sum(late for _, late, *_ in run(4, [placed[2], placed[3]], 4_000)) == 2


def test_live_interactions_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    for name in "ab":
        append(f"{tmp_path}/in/{name}.jsonl", [json.dumps(event(0, "session_meta", id=name, cwd="/w"))])
        said = [json.dumps(x) for n in range(1, 90) for x in [rng.choice([
            event(n, "event_msg", type="user_message", message=rng.choice([f"prompt {n}", "automation: go"])),
            event(n, "event_msg", type="agent_message", message=rng.choice(["same", f"answer {n}"])),
            event(n, "response_item", type="message", role="developer", content="context"),
            event(n, "event_msg", type="exec_command_end", call_id="c"),
            event(n, "event_msg", type="token_count", info={"last_token_usage": {"input_tokens": n, "total_tokens": n}})])]]
        append(f"{tmp_path}/in/{name}.jsonl", said)
    batch = load_corpus(spark, [f"{tmp_path}/in"])
    far = json.dumps({"timestamp": "2026-03-01T00:00:00.000Z", "type": "event_msg", "payload": {"type": "agent_message", "message": "much later"}})
    append(f"{tmp_path}/far/z.jsonl", [far])
    later = load_corpus(spark, [f"{tmp_path}/far"])
    streams = {}
    for name in ("messages", "tool_events", "token_usage"):
        table = getattr(batch, name)
        # Four files, each with records of a span of time; a record strays into the file after its own.
        place = F.floor((F.col("line") + F.when(F.xxhash64("line", F.lit(name)) % 2 == 0, 12).otherwise(0)) / 23)
        for part in range(5):
            table.filter(place == part).orderBy(F.xxhash64("line")).coalesce(1).write.parquet(f"{tmp_path}/s/{name}/{part}")
        getattr(later, name).coalesce(1).write.parquet(f"{tmp_path}/s/{name}/9")
        streams[name] = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s/{name}")
    closed = live_interactions(corpus_from_tables(spark, streams), "1 minute", 3_600_000)
    drain(closed, f"{tmp_path}/out", f"{tmp_path}/check")
    names = ["file_path", "session_id", "line", "turn_id", "timestamp", "prompt", "assistant_messages", "context_messages", "tool_events", "token_events", "last_response", "usage"]
    want = Counter(map(str, interactions.interactions(batch).select(names).collect()))
    got = Counter(map(str, spark.read.parquet(f"{tmp_path}/out").select(names).collect()))
    assert got == want and len(want) > 10
    assert at(1)
