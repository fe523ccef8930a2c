"""The corpus pipeline: STAGES in order, each over all rows that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to the shared folder and reads it again as the
next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as vocabulary_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import language_id, packing, simhash, substring
from logloom.llm.common import Staged, aside

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts that are null or without a letter go, and so do those with a posterior under a half."""
    labelled = docs.where(~language_id.held_out(docs["doc_id"]))
    return language_id.accepted(docs, language_id.train(labelled))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity 0.8 or more), the one with the smallest doc_id."""
    return simhash.deduplicated(docs, simhash.similar_plan())


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows of 35 repeated words cover.  A document that loses all its words stays, with an empty text."""
    placed = aside(docs, "text", "n_chars")
    kept = substring.remove_repeats(placed)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return kept.select(*placed.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_known_languages),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("best-fit packing", pack),
]

#: SQL can express none of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    staged, docs = Staged(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _ = staged.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
