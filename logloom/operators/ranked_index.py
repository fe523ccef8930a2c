"""A message index in rank order with a directory of counts: deep and large pages, match positions and resume tokens without a global sort.

A build is range-partitioned by rank (newest first, ties in corpus order), about ``part_rows`` rows to a part, and numbered in that order.  Beside it lie the
``directory``, the number of rows per (part, provider, day) with the times they span, and ``places``, the same per (part, file, chunk of lines).  An offset is looked up in counts per
part: those of the directory where provider and day are the only filters, else those of one narrow pass that reads the filters' columns.  Only the parts that hold the page are then
opened, and only their rows ranked, one part to a group; a page of any size stays spread over its parts.

A build belongs to one state of the corpus, its fingerprint.  It lies in a folder named after that, the session's time zone and the version of the rules, so nothing
is overwritten while it is read, and a search over a corpus that has changed since is refused (:class:`StaleIndex`).

Defined results: messages without a timestamp come last; an offset beyond the last match gives no rows; null paths, lines and sessions sort first among equal times, as in
``search_page``; an empty corpus gives an index of no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.text import search_result_id, snippet
from logloom.operators.fingerprint import cache_fingerprint
from logloom.operators.memo import rule_version
from logloom.operators.scans import line_chunk
from logloom.operators.search import (INDEX_COLUMNS, POSITION, SearchOptions, clamp_limit, clamp_offset, index_matches, match_index, message_index,
                                      running_before)
from logloom.operators.sessions import corpus_fingerprint
from logloom.operators.snapshots import read_snapshot, snapshot
from logloom.schema import Corpus, corpus_from_tables
from logloom.session import stage_table

PART_ROWS = 65_536
DIRECTORY_DDL = "part int, provider string, date_key string, n bigint, oldest string, newest string"
PLACES_DDL = "part int, provider string, date_key string, file_path string, _chunk bigint, n bigint"


class StaleIndex(LookupError):
    """No build of the index belongs to the corpus as it is now."""


@dataclass(frozen=True)
class RankedIndex:
    rows: DataFrame
    directory: DataFrame
    places: DataFrame


@dataclass(frozen=True)
class Token:
    """Where a page ended: the next one starts right after it, whatever has been counted before."""

    timestamp: str
    file_path: str | None
    line: int | None
    seq: int | None
    session_id: str | None
    rank: int


def token_of(row: Row) -> Token:
    """The token of a page's last row."""
    return Token(row["timestamp"] or "", row["file_path"], row["line"], row["seq"], row["session_id"], row["rank"])


def _time() -> Column:
    return F.coalesce("timestamp", F.lit(""))


def _order() -> list[Column]:
    return [F.desc(_time()), *map(F.col, POSITION)]


def _folder(spark: SparkSession, path: str, fingerprint: str) -> str:
    zone = spark.conf.get("spark.sql.session.timeZone")
    return f"{path.rstrip('/')}/{hashlib.sha256(f'{zone} {rule_version()} {fingerprint}'.encode()).hexdigest()[:32]}"


def _complete(spark: SparkSession, folder: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/places/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def write_ranked_index(corpus: Corpus, path: str, fingerprint: str | None = None, part_rows: int = PART_ROWS) -> str:
    """Build the index of a corpus unless it is there; returns the fingerprint it belongs to (that of ``corpus_fingerprint`` if none is given).

    The wide rows are staged once, so the sample that finds the range bounds does not derive them a second time.  ``places`` is written last and makes the build complete.
    """
    spark = corpus.messages.sparkSession
    fingerprint = fingerprint or corpus_fingerprint(corpus).first()["fingerprint"]
    folder = _folder(spark, path, fingerprint)
    if _complete(spark, folder):
        return fingerprint
    wide = stage_table(message_index(corpus))
    parts = max(1, -(-wide.count() // part_rows))
    laid = wide.repartitionByRange(parts, *_order()).withColumn("part", F.spark_partition_id())
    laid.sortWithinPartitions("part", *_order()).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
    rows = spark.read.schema(laid.schema).parquet(f"{folder}/rows")
    n = F.count(F.lit(1)).alias("n")
    (rows.groupBy("part", "provider", "date_key").agg(n, F.min(_time()).alias("oldest"), F.max(_time()).alias("newest"))
     .write.mode("overwrite").parquet(f"{folder}/directory"))
    (rows.groupBy("part", "provider", "date_key", "file_path", line_chunk().alias("_chunk")).agg(n)
     .write.mode("overwrite").parquet(f"{folder}/places"))
    return fingerprint


def open_ranked_index(spark: SparkSession, path: str, fingerprint: str) -> RankedIndex:
    """The build that belongs to a fingerprint; :class:`StaleIndex` if there is none."""
    folder = _folder(spark, path, fingerprint)
    if not _complete(spark, folder):
        raise StaleIndex(f"no index of the present corpus in {path}")
    rows = message_index(corpus_from_tables(spark, {})).schema.add("part", "integer")  # a build of no rows has no file to tell it
    return RankedIndex(*[spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in (("rows", rows), ("directory", DIRECTORY_DDL), ("places", PLACES_DDL))])


def cached_index(spark: SparkSession, cache: str, path: str, build: bool = False, part_rows: int = PART_ROWS) -> RankedIndex:
    """The index of a cache's latest snapshot; with ``build`` it is built where it is stale, else that is :class:`StaleIndex`."""
    at = snapshot(spark, cache)
    row = cache_fingerprint(spark, cache, at).first()
    state = f"{row['fingerprint']}-{row['state']}"
    if build:
        write_ranked_index(read_snapshot(spark, cache, at.version if at.version else None), path, state, part_rows)
    return open_ranked_index(spark, path, state)


def _counted(o: SearchOptions) -> bool:
    """Provider and day are the only filters, so counts are known."""
    blank = SearchOptions(limit=o.limit, offset=o.offset, provider=o.provider, date_key=o.date_key, aliases=o.aliases)
    return replace(o, query=o.query.strip()) == blank


def _by_day(df: DataFrame, o: SearchOptions) -> DataFrame:
    return index_matches(df, SearchOptions(provider=o.provider, date_key=o.date_key))


def _between(df: DataFrame, bounds: Row) -> DataFrame:
    """Rows of parts from ``bounds[0]`` to ``bounds[1]``: a filter on the folder, so no other part is listed or read."""
    return df.filter("false") if bounds[0] is None else df.filter(F.col("part").between(*bounds))


def _span(df: DataFrame) -> Row:
    """First and last part of a table; nulls if it is empty."""
    return df.agg(F.min("part"), F.max("part")).first()


def ranked_page(index: RankedIndex, o: SearchOptions) -> DataFrame:
    """One page, newest first: the rows and ids of ``search_page``, with ``seq`` for :func:`token_of`; ``model`` is the stored one."""
    first = clamp_offset(o.offset)
    return _page(index, _pruned(index, o), o, first, first)


def ranked_after(index: RankedIndex, o: SearchOptions, token: Token) -> DataFrame:
    """The page right after a token.  Parts are opened from the token's on, twice as many each time, until they hold a page; nothing before them is read."""
    here = F.struct(*[F.lit(x).cast(t).alias(c) for c, x, t in zip(
        POSITION, (token.file_path, token.line, token.seq, token.session_id), ("string", "bigint", "bigint", "string"))])
    place = F.struct(F.col("file_path"), F.col("line").cast("bigint").alias("line"), F.col("seq").cast("bigint").alias("seq"), F.col("session_id"))
    matches = _pruned(index, o).filter((_time() < token.timestamp) | ((_time() == token.timestamp) & (place > here)))
    low, high = _span(index.directory.filter(F.col("oldest") <= token.timestamp))
    if low is None:
        return _page(index, matches.filter("false"), o, 0, token.rank, known=False)
    width, limit = 1, clamp_limit(o.limit)
    while low + width <= high and matches.filter(F.col("part").between(low, low + width - 1)).count() < limit:
        width *= 2
    return _page(index, matches.filter(F.col("part").between(low, low + width - 1)), o, 0, token.rank, known=False)


def _pruned(index: RankedIndex, o: SearchOptions) -> DataFrame:
    """All matches, in the parts whose days can hold any."""
    days = index_matches(index.directory.withColumn("timestamp", F.lit(None).cast("string")), replace(
        SearchOptions(provider=o.provider, date_key=o.date_key), since=o.since, until=o.until))
    rows = index.rows
    if o.has_dates or (o.date_key or "").strip() or (o.provider and o.provider != "all"):
        rows = _between(rows, _span(days))
    return index_matches(rows, o)


def _page(index: RankedIndex, matches: DataFrame, o: SearchOptions, skip: int, before: int, known: bool = True) -> DataFrame:
    """Rows ``skip`` and on of ``matches``, ranked from ``before`` + 1; ``known`` if the directory may have their counts."""
    limit = clamp_limit(o.limit)
    counted = _counted(o)
    whole = _pruned(index, o)  # a resumed page numbers its ids among all matches, too
    places = _by_day(index.places, o).withColumnRenamed("n", "_n") if counted else stage_table(
        whole.groupBy("part", "file_path", line_chunk().alias("_chunk")).agg(F.count(F.lit(1)).alias("_n")))
    if not known:
        source = matches.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    elif counted:
        source = _by_day(index.directory, o).groupBy("part").agg(F.sum("n").alias("_n"))
    else:
        source = places.groupBy("part").agg(F.sum("_n").alias("_n"))
    counts = stage_table(running_before(source, ["part"]))
    held = counts.filter((F.col("_before") < skip + limit) & (F.col("_before") + F.col("_n") > skip))
    bounds = _span(held)
    place = F.row_number().over(W.partitionBy("part").orderBy(*_order())) + F.col("_before")
    page = _between(matches, bounds).join(_between(counts, bounds).select("part", "_before"), "part").withColumn("_place", place)
    page = stage_table(page.filter((F.col("_place") > skip) & (F.col("_place") <= skip + limit))
                       .withColumn("rank", F.col("_place") - skip + before).drop("_before", "_place"))
    near = _span(places.join(page.select("file_path", line_chunk().alias("_chunk")).distinct(), ["file_path", "_chunk"], "left_semi"))
    page = match_index(_between(whole, near), page, places.groupBy("file_path", "_chunk").agg(F.sum("_n").alias("_n")))
    return page.select(
        search_result_id(*[F.col(c) for c in ("file_path", "session_id", "line", "turn_id", "timestamp", "role", "source_event", "match_index")]).alias("id"),
        *INDEX_COLUMNS, "source_label", "title", "provider_conversation_id", "seq", snippet(F.col("content"), o.query).alias("snippet"), "content", "rank").orderBy("rank")
