"""A memo of distinct prompts: every text is classified once.

Prompts are known by the SHA-256 of their text.  The rules run over distinct texts only, and what they give is a table keyed by digest that all
parts of a summary join.  Kept in a folder, the memo is carried from run to run: a later run classifies only the texts it has not seen under the
present rules.  The version of the rules is a hash of all their data, so changed rules never read old rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import intents
from logloom.functions.content import is_submitted
from logloom.functions.intents import APP_NAMES, with_group_key
from logloom.functions.text import compact
from logloom.session import stage_table

COLUMNS = ("literal string, rule_no int, rule_key string, rule_label string, confidence string, signals array<string>, intent_key string, intent_label string, category string, "
           "variant_sample string, group_key string, group_sample string, example string")
MEMO_DDL = f"rule_version string, digest string, {COLUMNS}"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
EXAMPLE = 96


def rule_version(app_names: Sequence[str] = APP_NAMES) -> str:
    """Changes whenever a rule, a pattern or a label does."""
    data = {name: value for name, value in vars(intents).items() if name.isupper()} | {"APP_NAMES": list(app_names)}
    return hashlib.sha256(repr(sorted(data.items())).encode()).hexdigest()[:16]


def prompt_digest(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit("none"))


def distinct_prompts(messages: DataFrame) -> DataFrame:
    """(digest, content) of every text that was submitted; equal prompts fold before the shuffle."""
    said = messages.filter(is_submitted()).select(prompt_digest(F.col("content")).alias("digest"), "content")
    return said.groupBy("digest").agg(F.first("content").alias("content"))


def classified(distinct: DataFrame, app_names: Sequence[str] = APP_NAMES) -> DataFrame:
    """Memo rows of distinct prompts; the only place where a summary evaluates the rules."""
    rows = with_group_key(distinct, "content", list(app_names)).withColumn("example", compact(F.col("content"), EXAMPLE))
    return rows.select(F.lit(rule_version(app_names)).alias("rule_version"), "digest", *NAMES)


def read_memo(spark: SparkSession, path: str, app_names: Sequence[str] = APP_NAMES) -> DataFrame:
    """Rows of the present rules, one per digest even if two writers added the same text."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MEMO_DDL)
    return spark.read.schema(MEMO_DDL).parquet(path).filter(F.col("rule_version") == rule_version(app_names)).dropDuplicates(["digest"])


def prompt_memo(messages: DataFrame, path: str | None = None, app_names: Sequence[str] = APP_NAMES) -> DataFrame:
    """Memo rows of all prompts of ``messages``.  With a ``path``, new texts are classified and added to the folder there; all others are read."""
    spark = messages.sparkSession
    if path is None:
        return stage_table(classified(distinct_prompts(messages), app_names))
    missing = stage_table(distinct_prompts(messages).join(read_memo(spark, path, app_names).select("digest"), "digest", "left_anti"))
    if not missing.isEmpty():
        classified(missing, app_names).write.mode("append").parquet(path)
    return read_memo(spark, path, app_names)


def annotated(messages: DataFrame, memo: DataFrame) -> DataFrame:
    """Messages with ``digest`` and the memo's columns (null unless submitted) in place of their text, written once."""
    digest = F.when(is_submitted(), prompt_digest(F.col("content")))
    rows = messages.withColumn("digest", digest).drop("content")
    return stage_table(rows.join(memo.drop("rule_version"), "digest", "left"))


def grouped(df: DataFrame, content: str = "content") -> DataFrame:
    """Intent and group columns of prompts: those of a memo if the rows are annotated, else by the rules."""
    return df if "group_key" in df.columns else with_group_key(df, content)
