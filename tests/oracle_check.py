"""Run queries and comparison SQL side by side: ``python tests/oracle_check.py [sf] [name ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, float):
            return repr(round(v, 6)).removesuffix(".0")
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(entry.oracle_sql()[name])
    want = canonical(rel.columns, rel.fetchall())
    return sorted(df.columns) == sorted(rel.columns), got, want, sorted(df.columns), sorted(rel.columns)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[2:] or list(entry.queries())
    con, bad = connect(sf), 0
    for n in names:
        t = time.time()
        if n not in entry.oracle_sql():
            print("NOSQL", n)
            continue
        try:
            same, got, want, a, b = compare(spark, con, sf, n)
        except Exception as error:
            bad += 1
            print("ERROR", n, str(error)[:700], flush=True)
            continue
        ok = same and got == want
        bad += not ok
        print("ok  " if ok else "DIFF", n, len(got), len(want), f"{time.time() - t:.1f}s", flush=True)
        if not ok:
            print("   ", a, b)
            g, w = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
            print("    spark:", str(g[:2])[:600])
            print("    duck: ", str(w[:2])[:600])
    print("bad", bad)
