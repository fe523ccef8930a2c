"""Line dedup, resampling and the prefix trie against brute force, with nulls, empty, long, tied and repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import line_dedup, prefix_trie, resample
from logloom.llm.common import SLICE, Staged

CLASHES = ("n_lines", "n_dropped", "r1", "k1", "key", "line", "at", "lost", "doc", "first", "rank", "score", "weight", "n_features", "carried", "position", "depth", "c0", "a.b")


def frame(spark, rows, ddl, own):
    return spark.createDataFrame(rows, ddl).select(*own, *[F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in own])


# --- lines ---

BLANK = " \t\n\x0b\f\r"


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))


def deduped(rows, documents=2):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add(doc)
    first = {k: min(v, key=lambda d: (d is None, d)) for k, v in holders.items() if len(k) >= 10 and len(v) >= documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in first or first[line_key(x)] == doc]
        out.append((doc, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    rng = random.Random(3)
    common = ["A line that many hold", "  a LINE that many hold\t", "short", "ten chars!", "Été is not été", "été is not été", " nbsp stays as it is", "carriage return here\r", "carriage return here", ""]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"own line {i} {j}" for j in range(rng.randrange(1, 30)))) for i in range(150)]
    long = "\n".join(f"line number {j % 40_000} of a long one" for j in range(60_000))
    return rows + [(200, None), (201, ""), (202, "\n"), (203, "\n\n"), (204, long), (205, long), (3, rows[3][1]), (3, rows[3][1]), (3, "own line 3 0\nA line that many hold"),
                   (None, "A line that many hold\nonly without id"), (None, "only without id"), (None, None), (206, "only without id"), (207, "x" * 300_000), (208, "X" * 300_000)]


@pytest.mark.parametrize("documents", [2, 3])
def test_lines_match_brute_force(spark, documents):
    rows = line_rows()
    df = frame(spark, rows, "doc_id long, text string", ["doc_id", "text"]).repartition(7)
    out = line_dedup.drop_repeated_lines(df, documents=documents)
    assert out.columns == [c for c in df.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    got = Counter(tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert got == Counter(deduped(rows, documents))
    assert out.where(f"`a.b` <> {CLASHES.index('a.b')} or score <> {CLASHES.index('score')}").isEmpty()


def test_lines_of_a_hot_key_and_of_nothing(spark):
    rows = [(i, f"the one line that all of them hold\nown {i} with some words") for i in range(3000)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.agg(F.sum("n_dropped")).first()[0] == 2999
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(empty).columns == ["doc_id", "text", "n_lines", "n_dropped"] and line_dedup.drop_repeated_lines(empty).isEmpty()


def test_lines_stay_native(spark, capsys):
    line_dedup.drop_repeated_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


# --- resampling ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def drawn(rows, target):
    own, other = Counter(), Counter()
    for _, text in rows:
        own.update(features(text)[1])
    for (text,) in target:
        other.update(features(text)[1])
    s, t = own.total(), other.total()
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000)))) for b in own}
    out, able = [], []
    for doc, text in rows:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        able += [out[-1]] if n >= 20 else []
    best = sorted(able, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))[:25 * len(able) // 100]
    ranks = defaultdict(list)
    for i, r in enumerate(best):
        ranks[r].append(i + 1)
    return Counter((*r, ranks[r].pop(0) if ranks[r] else None) for r in out)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_draw_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma7", "été", "ÉTÉ", "delta-eps", "zeta_", "日本", "42", "x" * 70]
    rows = [(i, prose(rng, rng.randrange(60), words)) for i in range(400)]
    copy = prose(rng, 40, words)
    rows += [(500, copy)] * 60 + [(None, copy), (None, prose(rng, 30, words)), (501, None), (502, ""), (503, " .,;-\n"), (504, "word " * 300_000), (505, "y" * (3 * SLICE) + " z " + "w" * 100),
             (506, prose(rng, 19, ["a"])), (507, prose(rng, 20, ["a"])), (508, "A\x00b\x7fc " * 25)]
    target = [(prose(rng, 50, words[:3]),) for _ in range(20)] + [(None,), ("",)]
    df = frame(spark, rows, "doc_id long, text string", ["doc_id", "text"]).repartition(9)
    out = resample.resample(df, spark.createDataFrame(target, "text string"), carry=("rank", "a.b"))
    assert Counter(tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()) == drawn(rows, target)
    assert out.where("carried.rank <> 10 or carried.`a.b` <> 18").isEmpty()


def test_draw_of_nothing_and_towards_nothing(spark):
    empty, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(empty, none).collect() == []
    rows = [(i, f"some words number {i} " * 6) for i in range(30)]
    out = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), none)
    assert Counter(tuple(r) for r in out.collect()) == drawn(rows, [])
    few = [(1, "only five words are here")]
    assert [r["rank"] for r in resample.resample(spark.createDataFrame(few, "doc_id long, text string"), none).collect()] == [None]


def test_cutoff_is_exact(spark):
    rng = random.Random(2)
    rows = sorted((rng.randrange(40), rng.randrange(5)) for _ in range(3000))
    keys, _ = Staged(spark).table(spark.createDataFrame(rng.sample(rows, len(rows)), "a long, b long").repartition(13))
    for k in (1, 2, 750, 1500, 2999, 3000):
        assert resample.cutoff(keys, k) == rows[k - 1]


def test_long_text_counts_like_its_pieces():
    text = ("lorem Ipsum " * 200_000).encode()
    whole = resample._features(resample.LOWER[np.frombuffer(text, np.uint8)], np.array([len(text)]), 10_000)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode()])], names=["text"])
    cut = list(resample._parts(batch, 0, 10_000))
    assert len(cut) > 1 and (sum(np.bincount(p.buckets, minlength=10_000) for _, p in cut) == np.bincount(whole.buckets, minlength=10_000)).all()


# --- prefix trie ---

def trie(conversations):
    """conversations: id -> list of turns."""
    nodes = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = own + sum(saved[k] for k in kids[path])
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def test_trie_matches_brute_force(spark):
    rng = random.Random(8)
    said = ["hello", "yes", "", None, "日本語", "x" * 50_000]
    rows, conversations = [], {}
    for c in [*range(-3, 120), 10**12]:
        turns = [(t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(said)) for t in range(rng.randrange(7))]
        rows += [(c, *t) for t in turns]
        if turns:
            conversations[c] = [(r or "", x or "") for _, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))]
    rows += [(None, 0, "user", "nobody's")] * 3
    deep = [(300 + i, t, "user", f"turn {t}") for i in range(2) for t in range(3000)]
    conversations |= {300 + i: [("user", f"turn {t}") for t in range(3000)] for i in range(2)}
    silent = [(7000,), (7000,), (None,), (-50,)]
    conversations |= {7000: [], -50: []}
    df = frame(spark, rows + deep, "conv_id long, turn long, role string, text string", ["conv_id", "turn", "role", "text"]).repartition(5)
    every = df.select("conv_id").unionAll(spark.createDataFrame(silent, "conv_id long"))
    out = prefix_trie.prefix_trie(prefix_trie.numbered(df, Staged(spark)), every)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == trie(conversations)


def test_trie_of_many_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(20_000) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.numbered(df, Staged(spark))).collect())
    assert got == trie({c: [("user", "same 0"), ("user", "same 1")] for c in range(20_000)})
    assert prefix_trie.prefix_trie(prefix_trie.numbered(df.limit(0), Staged(spark))).collect() == []


def test_trie_of_growing_logs(spark):
    """Every conversation goes on from the one before: one event per turn."""
    rows = [(c, t, "user", f"{t}") for c in range(12) for t in range(12 - c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.numbered(df, Staged(spark))).collect())
    assert got == trie({c: [("user", f"{t}") for t in range(12 - c)] for c in range(12)})
