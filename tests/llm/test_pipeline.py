"""The pipeline against its stages' rules, on the smallest tables and on planted cases."""

import random
import zlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_registered():
    assert "pipeline" in entry.queries()
    assert sorted({int(q[2:].split("_")[0]) for q in entry.queries() if q.startswith("op")}) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "best-fit packing"]


def test_stages_keep_columns_and_take_effect(spark):
    rng = random.Random(0)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    prose = [r[0] for r in real.where("lang = 'en' and n_chars > 3000").select("text").limit(4).collect()]
    words = [p.split() for p in prose]
    passage = " ".join(rng.choice(words[0]) for _ in range(60))
    near = " ".join(words[1][:100] + ["edited"] + words[1][101:])
    extra = [(9001, prose[1]), (9002, near), (9003, f"{' '.join(words[2][:300])} {passage}"), (9004, f"{passage} {' '.join(words[3][:300])}"), (9005, "12 34 !!"), (9006, None)]
    planted = spark.createDataFrame(extra, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = real.where("doc_id < 150").unionByName(planted).select("*", F.lit(5).alias("score"), F.lit(6).alias("_r1"), F.lit(7).alias("n_removed"), F.lit(8).alias("a.b"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        ids, now = {r[0] for r in before.select("doc_id").collect()}, {r[0]: r for r in after.collect()}
        assert set(now) <= ids and all((r["score"], r["_r1"], r["n_removed"], r["a.b"]) == (5, 6, 7, 8) for r in now.values())
        if name == "language ID":
            assert {9005, 9006} <= ids - set(now) and len(ids - set(now)) < 15
        if name == "SimHash near-dedup":
            original = real.where(F.col("text") == prose[1]).agg(F.min("doc_id")).first()[0]
            assert original in now and not {9001, 9002} & set(now)
        if name == "substring dedup":
            assert not any(passage in " ".join(now[i]["text"].split()) for i in (9003, 9004)) and all(len(r["text"]) == r["n_chars"] for r in now.values())
        before = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in before.select("doc_id").collect()}


def test_run_and_empty_tables(spark, tmp_path):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) > 100 and all(0 <= r["offset"] <= r["offset"] + r["length"] <= 1024 for r in rows)
    assert max(r["ids_crc32"] for r in rows) <= zlib.crc32(b"") + 2**32
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
