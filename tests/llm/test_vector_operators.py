"""Vector operators and links against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import caps, topk
from logloom.llm.common import Staged, paired_blocks
from logloom.llm.components import connected_components

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=400, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    out = [(i, (centres[i % 20] + rng.normal(size=width) * rng.choice([0.02, 0.12, 1.0])).tolist(), int(i % 3)) for i in range(n)]
    out += [(n + i, out[5][1], 2) for i in range(30)]  # copies
    odd = [None, [], [0.0] * width, [None] + [1.0] * (width - 1), [math.nan] * width, [math.inf] * width, [1.0] * 3, [1.0] * 3]
    out += [(n + 100 + i, e, 1) for i, e in enumerate(odd)]
    return out + [(n + 200, out[5][1], None), (n + 201, [2 * x for x in out[5][1]], 2)]


def usable(e):
    return e and all(x is not None and math.isfinite(x) for x in e) and any(e)


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("node"), F.lit(2).alias("_key"), F.lit(3).alias("query"), F.lit(4).alias("rid"))


def brute_links(rows, least):
    links = {r[0]: set() for r in rows}
    x = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows if usable(r[1]) and r[2] is not None}
    label = {r[0]: r[2] for r in rows}
    for a in x:
        for b in x:
            if a < b and label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= least:
                links[a].add(b)
                links[b].add(a)
    return links


def reached(links):
    root = {}
    for n in sorted(links):
        todo = [n] if n not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo += links[x]
    return root


def test_caps(spark):
    rows = vectors()
    links = brute_links(rows, 0.98)
    root = reached(links)
    for block in (2048, 8):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.near_duplicates(frame(spark, rows), block=block).collect()}
        assert got == {v: (len(links[v]), root[v], root[v] == v) for v in links}
    assert sum(map(len, links.values())) > 1000


@pytest.mark.parametrize("width", [16, 64])
def test_caps_recall(spark, width):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):  # pairs just above the threshold
        a, b = rng.normal(size=(2, width))
        b -= (a @ b) / (a @ a) * a
        b *= np.linalg.norm(a) / np.linalg.norm(b) * math.tan(math.acos(0.9805))
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (a + b).tolist(), 0)]
    links = brute_links(rows, 0.98)
    got = sum(r["n_links"] for r in caps.near_duplicates(frame(spark, rows)).collect())
    assert got >= 0.99 * sum(map(len, links.values())) > 0


def test_caps_empty(spark):
    assert caps.near_duplicates(frame(spark, [])).count() == 0


def brute_top(rows, k):
    usable_rows = [(v, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e, _ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, a) in enumerate(usable_rows):
        if q is not None and q % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), c is None, c or 0, c) for j, (c, b) in enumerate(usable_rows) if j != i]
            out += [(q, rank, c, -s) for rank, (s, _, _, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rows = vectors(3) + [(None, [0.5] * 16, 0), (50, [0.1] * 16, 0)]  # an id twice, a null one
    for block in (4096, 40):
        got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, block=block)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)
    few = rows[:3] + [(100, [1.0] * 16, 1)]
    assert sorted(map(tuple, topk.top_k(frame(spark, few), F.col("vec_id") % 50 == 0).collect())) == brute_top(few, 5)
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_collects_few_entries(spark):
    """Far fewer entries leave the lists than there are pairs; copies are not all candidates; a long vector among short ones is whole."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=32).tolist(), 0) for i in range(1500)] + [(2000 + i, [0.3] * 32, 0) for i in range(600)] + [(2601, rng.normal(size=5000).tolist(), 0)]
    df = spark.createDataFrame(rows, VECTORS)
    asked = F.col("vec_id") % 50 == 0
    first, collected, last = topk.phases(df, asked, block=512)
    pairs = sum(r[0] % 50 == 0 for r in rows) * len(rows)
    assert 0 < collected.count() < pairs / 10 and first.count() + last.count() < pairs / 20
    assert sorted(map(tuple, topk.top_k(df, asked, block=512).collect())) == brute_top(rows, 5)


def test_top_k_large_components(spark):
    rows = [(i, [float(3 * 10 ** (i % 9)), 1.0 - i], 0) for i in range(12)]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows), F.lit(True)).where("query_id = 0").collect())) == [r for r in brute_top(rows, 5) if r[0] == 0]


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    links = {n: set() for p in pairs for n in p if n is not None}
    for a, b in pairs:
        if a is not None and b is not None:
            links[a].add(b)
            links[b].add(a)
    root = reached(links)
    linked = {n for n in links if links[n] - {n}}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", Staged(spark))
    assert sorted(map(tuple, got.collect())) == sorted((n, root[n]) for n in linked)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", Staged(spark)).count() == 0


def test_every_pair_meets_once(spark):
    rows = paired_blocks(spark.range(50).select("id", F.lit(1).alias("g"), F.lit(50).alias("n")), "n", "id", 8).collect()
    met = {}
    for r in rows:
        met.setdefault((r["_lo"], r["_hi"]), []).append(r)
    pairs = [tuple(sorted((a["id"], b["id"]))) for (lo, hi), own in met.items() for a in own for b in own if a["id"] < b["id"] and (lo == hi or a["_part"] != b["_part"])]
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2
