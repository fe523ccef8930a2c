import random

from conftest import rows
from pyspark.sql import functions as F

from logloom.operators import scans


def sample(seed=3):
    rnd = random.Random(seed)
    data = []
    for key, n in (("hot", 400), ("b", 30), ("c", 1)):
        data += [(key, i + 1, rnd.choice([None, None, rnd.randint(0, 99)]), rnd.randint(0, 1)) for i in range(n)]
    return data


def test_scans_match_brute_force_inside_one_huge_group(spark, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK_LINES", 16)
    data = sample()
    df = spark.createDataFrame(data, "k string, line bigint, v int, b int").repartition(5)
    got = scans.carry_forward(df, ["k"], ["line"], {"last_v": F.col("v")})
    got = scans.running_sum(got, ["k"], ["line"], {"total": F.col("b")})
    want, last, total = {}, {}, {}
    for k, line, v, b in data:
        last[k] = v if v is not None else last.get(k)
        total[k] = total.get(k, 0) + b
        want[(k, line)] = (last[k], total[k])
    assert {(r.k, r.line): (r.last_v, r.total) for r in got.collect()} == want


def test_ranked_matches_brute_force(spark):
    data = sample(5)
    df = spark.createDataFrame(data, "k string, line bigint, v int, b int").repartition(7)
    got = scans.ranked(df, ["k"], [F.desc("b"), F.col("line")], "r")
    want = {}
    for key in ("hot", "b", "c"):
        ordered = sorted((d for d in data if d[0] == key), key=lambda d: (-d[3], d[1]))
        want.update({(key, d[1]): i + 1 for i, d in enumerate(ordered)})
    assert {(r.k, r.line): r.r for r in got.collect()} == want


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(sample(), "k string, line bigint, v int, b int")
    out = scans.first_rows(df, ["k"], [F.col("line")], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Partial") >= 1
    assert sorted(rows(out, "k", "line")) == [("b", 1), ("b", 2), ("c", 1), ("hot", 1), ("hot", 2)]


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame(sample(), "k string, line bigint, v int, b int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scans.running_sum(df, ["k"], ["line"], {"total": F.col("b")})
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows by (key, chunk); summaries by (key, chunk), by key for the scan, and back for the join
    assert plan.count("Exchange hashpartitioning(k#") <= 4
    assert sum("_v_total" in line and "Exchange" in line for line in plan.splitlines()) <= 1
