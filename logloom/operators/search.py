"""Message search and the message index."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.content import is_codex_submitted, is_submitted
from logloom.functions.intents import OPERATIONAL, with_intent
from logloom.functions.text import normalize_query, normalize_text, search_result_id, snippet
from logloom.functions.times import UNKNOWN, day_key, in_range, parse_ts
from logloom.operators.context import SESSION, attach_model, attach_project
from logloom.operators.scans import line_chunk
from logloom.operators.scope import Scope, hidden_category, provider_in_scope
from logloom.schema import Corpus, record_provider
from logloom.session import stage_table

POSITION = ["file_path", "line", "seq", "session_id"]


@dataclass(frozen=True)
class SearchOptions(Scope):
    query: str = ""
    role: str | None = None
    model: str | None = None
    session_id: str | None = None
    file_path: str | None = None
    date_key: str | None = None
    submitted_only: bool = False
    hidden_categories: Sequence[str] = ()
    limit: int | None = None
    offset: int | None = None


def clamp_limit(limit: int | None, default: int = 100) -> int:
    return max(1, int(limit)) if limit else default


def clamp_offset(offset: int | None) -> int:
    return max(0, int(offset)) if offset else 0


def with_category(df: DataFrame) -> DataFrame:
    """Intent columns and operational category of codex prompts, null for every other message."""
    mine = is_codex_submitted()
    step = with_intent(df.withColumn("_text", F.when(mine, F.col("content"))), "_text")
    keep = F.col("_text").isNotNull()
    return step.select(
        *df.columns, F.when(keep, F.col("intent_key")).alias("intent_key"),
        F.when(keep, F.col("intent_label")).alias("intent_label"),
        F.when(keep & F.col("intent_key").isin(*OPERATIONAL), F.col("intent_label")).alias("category"))


def search_matches(corpus: Corpus, o: SearchOptions) -> DataFrame:
    """All messages that pass the filters, cheap tests first, joins only when a filter needs them."""
    m = corpus.messages.filter(provider_in_scope(o.provider))
    if (o.session_id or "").strip():
        m = m.filter(F.col("session_id") == o.session_id.strip())
    if (o.file_path or "").strip():
        m = m.filter(F.col("file_path") == o.file_path.strip())
    if o.role and o.role != "all":
        m = m.filter(F.col("role") == o.role)
    if o.submitted_only:
        m = m.filter(is_submitted())
    if o.has_dates:
        m = m.filter(in_range(F.col("timestamp"), o.since, o.until))
    if (o.date_key or "").strip():
        m = m.filter(day_key(F.col("timestamp")) == o.date_key.strip())
    if normalize_query(o.query):
        m = m.filter(normalize_text(F.col("content")).contains(F.lit(normalize_query(o.query))))
    if o.one_project:
        m = attach_project(m, corpus, o.aliases).filter(F.col("project") == o.one_project).drop("project")
    if (o.model or "").strip() not in ("", "all"):
        m = attach_model(m, corpus.turns).filter(F.coalesce("model", F.lit("unknown")) == o.model.strip()).drop("model")
    hidden = [h.strip() for h in o.hidden_categories if h.strip()]
    if hidden:
        m = with_category(m).filter(hidden_category(F.col("category"), hidden)).select(*m.columns)
    return m


def search_count(corpus: Corpus, o: SearchOptions) -> DataFrame:
    return search_matches(corpus, o).agg(F.count(F.lit(1)).alias("total_matches"))


def match_index(matches: DataFrame, page: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """0-based corpus position among all matches, for the rows of a page.

    Matches are counted per (file, chunk); only chunks with a page row are numbered row by row.  ``counts`` (file_path, _chunk, _n)
    are those counts where they are known; ``matches`` then needs the rows of the page's chunks only.
    """
    on = ["file_path", "_chunk"]
    placed = matches.select(*POSITION).withColumn("_chunk", line_chunk())
    page = page.withColumn("_chunk", line_chunk())
    if counts is None:
        counts = placed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    # Running totals over the chunk list, itself range-partitioned: rank every chunk, then add up partitions.
    before = running_before(counts, on).drop("_n")
    inside = placed.join(page.select(*on).distinct(), on, "left_semi")
    inside = inside.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*POSITION))).alias("_all"))
    index = F.array_position("_all", F.struct(*POSITION)) - 1
    return (page.join(before, on).join(inside, on)
            .withColumn("match_index", F.col("_before") + index).drop("_chunk", "_before", "_all"))


def running_before(counts: DataFrame, order: list[str]) -> DataFrame:
    """Counts ``_n`` with the sum of all counts before them, ``_before``."""
    laid = stage_table(counts.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sums = laid.groupBy("_pid").agg(F.sum("_n").alias("_s"))
    off = sums.select("_pid", F.coalesce(
        F.sum("_s").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    within = W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return laid.join(F.broadcast(off), "_pid").select(
        *order, "_n", (F.col("_o") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_before"))


def search_page(corpus: Corpus, o: SearchOptions) -> DataFrame:
    """One page of results, newest first, ties in corpus order; details are added after the limit.

    ``rank`` counts from 1 over all matches; the rows come in its order.
    """
    matches = search_matches(corpus, o)
    order = [F.desc(F.coalesce("timestamp", F.lit(""))), *map(F.col, POSITION)]
    page = stage_table(matches.orderBy(*order).offset(clamp_offset(o.offset)).limit(clamp_limit(o.limit)))
    page = page.withColumn("rank", clamp_offset(o.offset) + F.row_number().over(W.orderBy(*order)))
    page = match_index(matches, page)
    page = attach_project(attach_model(page, corpus.turns), corpus, o.aliases, keep_cwd=True)
    page = with_category(page)
    return page.select(
        search_result_id(*[F.col(c) for c in ("file_path", "session_id", "line", "turn_id", "timestamp", "role",
                                              "source_event", "match_index")]).alias("id"),
        record_provider().alias("provider"), "source_label", "title", "provider_conversation_id", *SESSION,
        day_key(F.col("timestamp")).alias("date_key"), "project", F.col("session_cwd").alias("cwd"), "line", "turn_id",
        F.when(F.col("turn_id") != "", F.col("model")).alias("model"), "timestamp", "role", "source_event", "category",
        "intent_key", "intent_label", snippet(F.col("content"), o.query).alias("snippet"), "content", "rank").orderBy("rank")


def message_index(corpus: Corpus) -> DataFrame:
    """Wide message table for browsing and search.

    The model is ``unknown`` when the turn is missing and null without a turn.
    """
    m = attach_project(attach_model(corpus.messages, corpus.turns), corpus, keep_cwd=True)
    m = with_category(m)
    return m.select(
        search_result_id(*[F.col(c) for c in ("file_path", "provider", "session_id", "line", "turn_id", "timestamp",
                                              "role", "source_event", "seq")]).alias("id"),
        record_provider().alias("provider"), "source_label", "title", "provider_conversation_id", *SESSION,
        day_key(F.col("timestamp")).alias("date_key"), "project", F.col("session_cwd").alias("cwd"), "line", "seq",
        "turn_id", F.when(F.col("turn_id") != "", F.coalesce("model", F.lit("unknown"))).alias("model"), "timestamp",
        parse_ts(F.col("timestamp")).alias("ts"), "role", "source_event", "category", "intent_key", "intent_label",
        normalize_text(F.col("content")).alias("normalized_content"), "content")


def write_message_index(corpus: Corpus, path: str) -> None:
    """Parquet by provider, sorted by day, project and time inside a file for min/max skipping.

    The rows are range-partitioned on provider, day, project and time, so a day of any size spreads over tasks, and the number of files goes by
    the tasks, not by the days.  They are written once before, as drawing the ranges reads them a first time.
    """
    index = stage_table(message_index(corpus))
    (index.repartitionByRange("provider", "date_key", "project", F.coalesce("timestamp", F.lit("")), "id")
     .sortWithinPartitions("provider", "date_key", "project", "timestamp")
     .write.mode("overwrite").partitionBy("provider").parquet(path))


INDEX_COLUMNS = ["provider", *SESSION, "date_key", "project", "cwd", "line", "turn_id", "model", "timestamp", "role", "source_event", "category",
                 "intent_key", "intent_label"]


def index_matches(index: DataFrame, o: SearchOptions) -> DataFrame:
    """Rows of a message index that pass the filters of a search, all of them tests of stored columns.  Projects are those of the index, so
    ``aliases`` have no effect.
    """
    m = index.withColumn("date_key", F.col("date_key").cast("string"))
    if o.provider and o.provider != "all":
        m = m.filter(F.col("provider") == o.provider)
    for value, column in ((o.session_id, "session_id"), (o.file_path, "file_path"), (o.date_key, "date_key")):
        if (value or "").strip():
            m = m.filter(F.col(column) == value.strip())
    if o.role and o.role != "all":
        m = m.filter(F.col("role") == o.role)
    if o.submitted_only:
        m = m.filter(is_submitted())
    if o.has_dates:
        undated, day = F.col("date_key") == UNKNOWN, F.col("date_key")
        since, until = (b[:10] if b and re.match(r"\d{4}-\d{2}-\d{2}($|T)", b) else None for b in (o.since, o.until))
        for kept in ([undated | (day >= F.date_format(F.date_sub(F.lit(since).cast("date"), 1), "yyyy-MM-dd"))] if since else []) + (
                [undated | (day <= F.date_format(F.date_add(F.lit(until).cast("date"), 1), "yyyy-MM-dd"))] if until else []):
            m = m.filter(kept)  # a day of slack for bounds in another zone; the exact test follows
        m = m.filter(in_range(F.col("timestamp"), o.since, o.until))
    if normalize_query(o.query):
        m = m.filter(F.col("normalized_content").contains(F.lit(normalize_query(o.query))))
    if o.one_project:
        m = m.filter(F.col("project") == o.one_project)
    if (o.model or "").strip() not in ("", "all"):
        m = m.filter(F.coalesce("model", F.lit("unknown")) == o.model.strip())
    hidden = [h.strip() for h in o.hidden_categories if h.strip()]
    if hidden:
        m = m.filter(hidden_category(F.col("category"), hidden))
    return m


def search_index(index: DataFrame, o: SearchOptions) -> DataFrame:
    """The rows of :func:`search_page` without their ids, from the table of :func:`write_message_index`; ``model`` is the stored one.

    One pass, nothing derived anew: the provider prunes the folders that are read, the day their row groups.  :mod:`logloom.operators.ranked_index` serves deep and large pages.
    """
    m = index_matches(index, o)
    order = [F.desc(F.coalesce("timestamp", F.lit(""))), *map(F.col, POSITION)]
    page = m.orderBy(*order).offset(clamp_offset(o.offset)).limit(clamp_limit(o.limit))
    page = page.withColumn("rank", clamp_offset(o.offset) + F.row_number().over(W.orderBy(*order)))
    return page.select(*INDEX_COLUMNS, snippet(F.col("content"), o.query).alias("snippet"), "content", "rank").orderBy("rank")


def demo_search(rows: DataFrame, query: str = "", role: str = "all", project: str | None = None) -> DataFrame:
    """Plain containment over content, snippet and project."""
    out = rows
    if project and project != "All Projects":
        out = out.filter(F.col("project") == project)
    if role != "all":
        out = out.filter(F.col("role") == role)
    q = query.strip().lower()
    if q:
        out = out.filter(F.lower(F.concat_ws(" ", "content", "snippet", "project")).contains(F.lit(q)))
    return out


def newest_first(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column))
