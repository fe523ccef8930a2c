import json
import os
import sqlite3

from conftest import at, event, rows

from logloom import load_corpus
from logloom.sources.discovery import log_files
from logloom.sources.lines import read_lines


def session(extra=()):
    return [
        event(0, "session_meta", id="S1", timestamp=at(0), cwd="/work/app", originator="cli", cli_version=7),
        event(1, "turn_context", turn_id="t1", model="m1", effort="high", collaboration_mode={"mode": "default"}),
        event(1, "event_msg", type="task_started", turn_id="t1", started_at=5),
        event(2, "event_msg", type="user_message", message="<image name=x></image>\n# Files\n## My request for Codex:\nFix it \n",
              images=["a"], local_images=["b", "c"]),
        "", "{broken", "[1, 2]", '{"a": 1} trailing',
        event(3, "event_msg", type="token_count", info=None),
        event(3, "event_msg", type="token_count", rate_limits={"b": 1, "a": 2}, info={
            "last_token_usage": {"input_tokens": 100, "cached_input_tokens": 20, "output_tokens": "9", "total_tokens": 105},
            "model_context_window": 9}),
        event(4, "response_item", type="message", role="assistant",
              content=[{"type": "output_text", "text": "done"}, {"text": ""}, "more", {"content": [{"text": "deep"}]}]),
        event(5, "response_item", type="function_call", name="shell", call_id="c1", arguments="ls"),
        event(5, "response_item", type="function_call_output", id="c2", output="  ok "),
        event(5, "event_msg", type="exec_command_end", cwd="/x", exit_code=1, duration={"millis": 2.5}),
        event(5, "event_msg", type="weird", x="y" * 10000),
        {"timestamp": at(5), "type": "mystery", "payload": {"type": "user_message", "message": "no"}},
        event(5, "response_item", type="reasoning", summary=[]),
        event(6, "event_msg", type="task_complete", duration_ms=13000, last_agent_message="bye"),
        event(7, "event_msg", type="user_message", message="Automation: nightly"),
        *extra,
    ]


def test_rollout(spark, write):
    path = write("logs/rollout-abc.jsonl", session())
    c = load_corpus(spark, [os.path.dirname(path)])
    assert rows(c.files, "session_id", "line_count") == [("S1", 19)]
    assert rows(c.sessions, "cwd", "originator", "cli_version") == [("/work/app", "cli", None)]
    assert rows(c.turns, "turn_id", "model", "cwd", "collaboration_mode") == [("t1", "m1", "/work/app", "default")]
    assert sorted(rows(c.messages, "line", "role", "content", "images_count", "local_images_count", "turn_id")) == [
        (4, "user", "Fix it", 1, 2, "t1"), (11, "assistant", "done\nmore\ndeep", 0, 0, "t1"),
        (19, "automation", "Automation: nightly", 0, 0, "t1")]
    usage = c.token_usage.collect()
    assert len(usage) == 1 and tuple(usage[0].usage) == (100, 20, 0, 20, 80, 0, 0, 105)
    assert json.loads(usage[0].rate_limits) == {"b": 1, "a": 2}
    assert rows(c.task_timings, "turn_id", "started_at", "duration_ms", "last_agent_message") == [("t1", 5.0, 13000.0, "bye")]
    assert sorted(rows(c.tool_events, "line", "event_type", "call_id", "content", "exit_code", "duration_ms")) == [
        (12, "function_call", "c1", "ls", None, None), (13, "function_call_output", "c2", "ok", None, None),
        (14, "exec_command_end", None, None, 1, 2.5)]
    unknown = {r.line: r for r in c.unknown_events.collect()}
    assert set(unknown) == {15, 16} and unknown[15].raw_truncated and unknown[16].raw_truncated is None
    assert json.loads(unknown[15].raw)["payload"]["x"] == {"truncated": True, "type": "string", "length": 10000}
    assert sorted(rows(c.warnings, "line", "code")) == [(6, "malformed_json"), (8, "malformed_json")]


def test_session_switch_is_carried(spark, write):
    path = write("a.jsonl", session([event(20, "session_meta", id="S2"), event(21, "turn_context", turn_id="t9"),
                                     event(22, "event_msg", type="agent_message", message="hi")]))
    c = load_corpus(spark, [path])
    assert rows(c.files, "session_id") == [("S2",)]
    assert rows(c.messages.filter("line = 22"), "session_id", "turn_id") == [("S2", "t9")]
    assert rows(c.turns.filter("line = 21"), "cwd") == [(None,)]


def test_lines_are_numbered_across_splits(spark, write):
    texts = [("x" * (i % 7)) + str(i) if i % 5 else "" for i in range(500)]
    path = write("big.jsonl", texts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted(rows(read_lines(spark, [path]), "line", "value"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i + 1, t) for i, t in enumerate(texts)]


def test_claude(spark, write):
    write("c.jsonl", [
        {"type": "user", "sessionId": "C1", "uuid": "u1", "timestamp": at(1), "cwd": "/w/lib", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "sessionId": "C1", "uuid": "u2", "timestamp": at(2), "message": {
            "role": "assistant", "model": "cl", "usage": {"input_tokens": 10, "cache_creation_input_tokens": 2,
                                                          "cache_read_input_tokens": 3, "output_tokens": 5},
            "content": [{"type": "text", "text": "hi"}, {"type": "image"},
                        {"type": "tool_use", "id": "x", "name": "Read", "input": {"p": 1}}]}},
        {"type": "user", "sessionId": "C1", "message": {"role": "user", "content": [
            {"type": "tool_result", "tool_use_id": "x", "content": [{"text": "ok"}]}]}},
        {"type": "summary", "summary": "A title"}, {"type": "system", "content": "note"},
        {"type": "other-kind"}, {"type": "attachment", "sessionId": "C2"}, "{oops",
    ])
    path = write(".claude/projects/p/e.jsonl", [], text="\n")
    c = load_corpus(spark, [path.split("/.claude/")[0]])
    assert sorted(rows(c.files, "provider", "session_id", "line_count")) == [("claude", "C2", 8), ("claude", "e", 1)]
    assert sorted(rows(c.sessions, "session_id", "cwd", "title", "timestamp")) == [
        ("C1", "/w/lib", "A title", at(1)), ("C2", "/w/lib", "A title", None), ("e", None, None, None)]
    assert [tuple(r.usage) for r in c.token_usage.collect()] == [(10, 5, 2, 3, 10, 5, 0, 20)]
    assert sorted(rows(c.messages, "line", "role", "content", "images_count", "turn_id")) == [
        (1, "user", "hello", 0, "u1"), (2, "assistant", "hi", 1, "u2"), (5, "system", "note", 0, "C1:5")]
    assert sorted(rows(c.tool_events, "line", "seq", "event_type", "name", "call_id", "content")) == [
        (2, 3, "tool_use", "Read", "x", '{"p":1}'), (3, 1, "tool_result", None, "x", "ok")]
    assert sorted(rows(c.unknown_events, "line", "top_level_type")) == [(4, "summary"), (6, "other-kind"), (7, "attachment")]
    assert rows(c.warnings, "line") == [(8,)]


def store(path, bubbles, headers=None, table="cursorDiskKV"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    db = sqlite3.connect(path)
    db.execute(f"CREATE TABLE {table} (key TEXT, value BLOB)")
    db.executemany(f"INSERT INTO {table} VALUES (?, ?)", bubbles)
    if headers is not None:
        db.execute("CREATE TABLE ItemTable (key TEXT, value BLOB)")
        db.execute("INSERT INTO ItemTable VALUES ('composer.composerHeaders', ?)", [json.dumps(headers).encode()])
    db.commit()
    db.close()
    return path


def test_chat_store(spark, tmp_path):
    base = str(tmp_path / "Cursor" / "User")
    path = store(f"{base}/globalStorage/state.vscdb", [
        ("bubbleId:k1:b2", json.dumps({"type": 2, "text": "Done", "createdAt": 1767225602, "turnDurationMs": 42,
                                       "tokenCount": {"inputTokens": 12, "outputTokens": 7},
                                       "toolResults": [{"name": "Run", "output": " out "}, 5]}).encode()),
        ("bubbleId:k1:b1", json.dumps({"type": 1, "text": "Do", "createdAt": "2026-01-01T00:00:01Z", "images": [1]})),
        ("bubbleId:k1:b3", json.dumps({"type": 7, "text": "odd", "createdAt": 1767225603000})),
        ("bubbleId:k1:b4", "{bad"), ("other:1", "{}"),
    ], {"allComposers": [{"composerId": "k1", "name": "Chat", "createdAt": 1767225600,
                          "workspaceIdentifier": {"id": "w1"}}]})
    os.makedirs(f"{base}/workspaceStorage/w1")
    with open(f"{base}/workspaceStorage/w1/workspace.json", "w") as f:
        json.dump({"folder": "file:///work/my%20app"}, f)
    c = load_corpus(spark, [str(tmp_path)])
    assert rows(c.files, "session_id", "title", "line_count") == [("k1", "Chat", 3)]
    assert rows(c.sessions, "timestamp", "cwd") == [("2026-01-01T00:00:00.000Z", "/work/my app")]
    assert sorted(rows(c.messages, "line", "role", "content", "images_count", "timestamp")) == [
        (1, "user", "Do", 1, at(1)), (2, "assistant", "Done", 0, at(2))]
    assert [r.usage.total_tokens for r in c.token_usage.collect()] == [19]
    assert rows(c.task_timings, "turn_id", "duration_ms") == [("b2", 42.0)]
    assert rows(c.tool_events, "name", "call_id", "content", "cwd") == [("Run", "b2:tool:1", "out", "/work/my app")]
    assert rows(c.unknown_events, "line", "payload_type") == [(3, "7")]
    assert rows(c.warnings, "line", "code") == [(4, "malformed_cursor_record")]
    assert path


def test_unusable_stores(spark, tmp_path):
    a = store(str(tmp_path / "a.vscdb"), [], table="elsewhere")
    b = store(str(tmp_path / "b.vscdb"), [])
    (tmp_path / "c.vscdb").write_bytes(b"no database at all, just text")
    c = load_corpus(spark, [a, b, str(tmp_path / "c.vscdb")])
    codes = {r.file_path[-7:]: r.code for r in c.warnings.collect()}
    assert codes["a.vscdb"] == "unsupported_cursor_vscdb" and codes["b.vscdb"] == "cursor_vscdb_no_chats"
    assert codes["c.vscdb"] in ("cursor_vscdb_open_failed", "cursor_vscdb_parse_failed")
    assert c.files.count() == 3 and c.messages.count() == 0


def test_markdown(spark, write):
    path = write("chat.md", [], text="# My chat\r\n\r\nintro\n## User\n\nFix it\n\n### Assistant \nok\n**You**: thanks\nAI: bye\n## AI\n\n")
    none = write("none.md", [], text="just text\n")
    c = load_corpus(spark, [path, none])
    assert sorted(rows(c.messages, "line", "role", "content", "title")) == [
        (4, "user", "Fix it", "My chat"), (8, "assistant", "ok", "My chat"), (10, "user", "thanks", "My chat"),
        (11, "assistant", "bye", "My chat")]
    assert rows(c.warnings, "code", "title") == [("cursor_markdown_no_messages", "none.md")]
    assert c.sessions.count() == 2


def test_discovery(spark, write):
    a = write("in/a.jsonl", ["{}"])
    write("in/node_modules/b.jsonl", ["{}"])
    write("in/c.md", ["x"])
    d = write("in/d.md", ["x"])
    root = os.path.dirname(a)
    assert sorted(rows(log_files(spark, [root, d]), "file_path", "kind")) == [(a, "jsonl"), (d, "md")]
    assert rows(log_files(spark, [root], "cursor")) == []
    assert rows(log_files(spark, [root + "/missing"])) == []


def test_log_folders_below_homes(spark, write, tmp_path):
    a = write("homes/ana/.codex/sessions/2026/a.jsonl", [event(0, "session_meta", id="A")])
    b = write("homes/team/bo/.claude/projects/p/b.jsonl", [{"type": "summary", "summary": "x"}])
    for root in (str(tmp_path / "homes"), f"file://{tmp_path}/homes"):
        assert sorted(rows(log_files(spark, [root]), "file_path")) == [(a,), (b,)]


def test_walk_of_deep_dot_folders_and_links(spark, write, tmp_path):
    from logloom.sources.corpus import load_corpus
    from logloom.sources.walk import walk

    deep = write("lake/a/b/c/d/.hidden/.codex/sessions/x.jsonl", [event(0, "session_meta", id="A"), event(1, "turn_context", cwd="/w")])
    under = write("lake/_team/_y.jsonl", [event(0, "session_meta", id="B")])
    empty = write("lake/empty.jsonl", [], "")
    write("lake/a/.git/z.jsonl", ["{}"])
    wide = [write(f"lake/wide/{i}/{i % 7}/n.jsonl", ["{}"]) for i in range(60)]
    os.symlink(tmp_path / "lake", tmp_path / "lake/a/loop")
    os.symlink(tmp_path / "lake/a/b", tmp_path / "lake/again")
    os.symlink(tmp_path / "nowhere", tmp_path / "lake/dangling.jsonl")
    outside = write("elsewhere/o.jsonl", ["{}"])
    os.symlink(tmp_path / "elsewhere", tmp_path / "lake/zz")
    root, linked = str(tmp_path / "lake"), f"{tmp_path}/lake/zz/o.jsonl"
    for ahead in (1, 3, 256):
        got = rows(walk(spark, [root, f"{root}/a/b"], (".jsonl",), ahead), "file_path")
        assert sorted(got) == sorted((p,) for p in [deep, under, empty, linked, *wide])
    assert rows(walk(spark, [root, str(tmp_path / "elsewhere")], (".jsonl",)).filter("file_path like '%o.jsonl'"), "file_path") == [(outside,)]
    sizes = dict(rows(log_files(spark, [f"file://{root}"]), "file_path", "size"))
    assert sizes[deep] == os.path.getsize(deep) and sizes[empty] == 0 and len(sizes) == 64
    corpus = load_corpus(spark, [root])
    assert {("A",), ("B",)} <= set(rows(corpus.sessions, "session_id"))


def test_workspaces_of_two_stores(spark, write, tmp_path):
    from logloom.sources.corpus import _workspaces

    write("one/User/workspaceStorage/w1/workspace.json", [{"folder": "file:///w/app"}])
    stores = [(f"{tmp_path}/{n}/User/globalStorage/state.vscdb", "vscdb") for n in ("one", "two")]
    found = _workspaces(spark, spark.createDataFrame(stores, "file_path string, kind string")).collect()
    assert len(found) == 1 and "/w/app" in found[0].value


def test_deep_content_is_kept(spark):
    from logloom.functions.content import content_to_text
    from logloom.functions.jsonv import parse_line

    def nest(depth):
        value = [{"text": "deep"}]
        for i in range(depth):
            value = [{"content": value}, {"text": f"t{i}"}]
        return json.dumps({"content": value})

    df = spark.createDataFrame([(d, nest(d)) for d in (0, 4, 9, 20, 40, 450)], "d int, v string")
    got = dict(rows(df.select("d", content_to_text(parse_line(df.v), "$.content").alias("t")), "d", "t"))
    for depth, text in got.items():
        assert text.split("\n") == ["deep", *[f"t{i}" for i in range(depth)]]
    mixed = [None, 1, "s", {"text": ""}, {"content": []}, {"content": ["", {"content": "c"}]}, {"output_text": "o", "content": ["no"]}, {"content": [[1], {"text": "", "content": ["no"]}]}]
    df = spark.createDataFrame([(json.dumps({"content": mixed}),), (None,)], "v string")
    assert rows(df.select(content_to_text(parse_line(df.v), "$.content").alias("t")), "t") == [("s\nc\no",), ("",)]


def test_long_strings_are_parsed(spark):
    from logloom.functions.jsonv import parse_line, str_at

    df = spark.range(1).selectExpr("""concat('{"t":"', repeat('x', 30000000), '"}') AS v""")
    assert df.selectExpr("v").select(str_at(parse_line(df.v), "$.t").alias("t")).selectExpr("length(t)").first()[0] == 30_000_000
