"""Line dedup: lines that other documents hold too stay in one of them only.

Lines are exploded under normalised keys, keys are hashed to 128 bits, and every hash gets its first and last document by an aggregate that
folds before the shuffle.  Hashes of several documents are few beside all lines; they are written once and joined back to the lines, and
what goes are positions, so texts are moved once, to be reassembled.  All of it is DataFrame functions.

Defined results: a null or empty text is one empty line.  Keys of fewer than ``least`` code points never lose a line.  A document is a value of
the id: rows with equal ids count as one document, and each keeps or loses its lines alike; rows without an id count together as one document
that comes after all others.  Repeated lines of the document that keeps a key all stay there.  A document that loses all its lines stays with
an empty text.  Texts of any length that a row holds are taken whole.  Empty tables give empty results.  Columns of the input come back as they
are; those named like the new ones (``n_lines``, ``n_dropped``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Staged, aside

#: What is stripped at both ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """What lines are compared by."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(first: str, second: str, *parts: Column | str) -> list[Column]:
    """128 bits of ``parts``, as two hashes that start from different values."""
    return [F.xxhash64(*parts).alias(first), F.xxhash64(F.lit(1), *parts).alias(second)]


def drop_repeated_lines(docs: DataFrame, least: int = 10, documents: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that stay, and ``n_lines`` (before) and ``n_dropped``; a key found in at least ``documents`` documents loses its lines
    in all but the first of them."""
    if documents < 1:
        raise ValueError("a line is found in one document at least")
    staged = Staged(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped") or c in (doc_id, text)]
    rows = aside(docs.select(*[docs[f"`{c}`"] for c in names]), doc_id, text).withColumnsRenamed({doc_id: "_id", text: "_text"})
    # A row is known by its id and text: equal rows lose equal lines.
    rows = rows.select("*", *_hashes("r1", "r2", "_id", "_text"))
    placed = rows.select("r1", "r2", F.col("_id").alias("doc"), F.posexplode(_lines(F.col("_text"))).alias("at", "line"))
    keyed = placed.where(F.length(F.trim("line", F.lit(BLANKS))) >= least)
    lines, _ = staged.table(keyed.select("r1", "r2", "doc", "at", *_hashes("k1", "k2", line_key(F.col("line")))))
    known, absent = F.col("doc").isNotNull(), F.bool_or(F.col("doc").isNull())
    seen = lines.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), absent.alias("absent"))
    if documents > 2:  # two are told by the first and the last; more have to be counted, each document once
        each = lines.groupBy("k1", "k2", "doc").agg(F.count(F.lit(1)).alias("_"))
        seen = each.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), absent.alias("absent"),
                                            F.count(F.lit(1)).alias("n")).where(F.col("n") >= documents)
    several = (F.col("first") != F.col("last")) | (F.col("absent") & F.col("first").isNotNull())
    # This table and the next are written, so that a join can split a key that holds much of the table.
    repeated, _ = staged.table(seen.where(several).select("k1", "k2", "first"))
    gone = ~known | (F.col("doc") != F.col("first"))
    lost = lines.join(repeated, ["k1", "k2"]).where(gone).groupBy("r1", "r2").agg(F.collect_set("at").alias("lost"))
    lost, _ = staged.table(lost)
    both = rows.join(lost, ["r1", "r2"], "left")
    # The lines are a column of their own, used more than once: they are split once a row, not once a position.
    both = both.withColumn("_split", _lines(F.col("_text")))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("lost"))
    kept = F.array_join(F.transform(stays, lambda at: F.get("_split", at)), "\n")
    out = both.withColumns({"_lines": F.size("_split"), "_lost": F.coalesce(F.size("lost"), F.lit(0)),
                            "_text": F.when(F.col("lost").isNull(), F.col("_text")).otherwise(kept)})
    return out.select(*rows.columns[:-2], F.col("_lines").cast("long"), F.col("_lost").cast("long")).toDF(*names, "n_lines", "n_dropped")
