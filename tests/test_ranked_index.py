"""The rank-ordered index against ``search_page``, and its fingerprint against the one from scratch."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_growth import append, claude_lines, codex_lines

from logloom.operators import fingerprint, ranked_index, refresh, snapshots
from logloom.operators.search import SearchOptions, search_page
from logloom.operators.sessions import corpus_fingerprint

COLUMNS = ["id", "file_path", "session_id", "line", "timestamp", "content", "snippet", "rank"]


def listed(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("ranked")
    rng, root, cache, path = random.Random(5), f"{base}/in", f"{base}/cache", f"{base}/index"
    append(f"{root}/a.jsonl", codex_lines(rng, 150, 0))
    append(f"{root}/b.jsonl", codex_lines(rng, 120, 0))  # equal times
    append(f"{root}/.claude/projects/p/c.jsonl", claude_lines(rng, 80, 100))
    refresh.refresh_corpus(spark, cache, [root])
    return rng, root, cache, path, ranked_index.cached_index(spark, cache, path, build=True, part_rows=9)


def test_pages_equal_the_search(spark, built):
    _, _, cache, _, index = built
    corpus = refresh.read_cache(spark, cache)
    assert index.rows.select("part").distinct().count() > 5
    day = corpus.messages.selectExpr("substr(timestamp, 1, 10)").first()[0]
    for options in ({"offset": 40, "limit": 30}, {"limit": 10_000}, {"offset": 5_000}, {"query": "1", "offset": 11}, {"provider": "codex", "date_key": day, "offset": 20},
                    {"role": "assistant", "since": "2026-01-01T00:01:00Z", "until": "2026-01-01T00:02:00Z"}, {"date_key": "1999-01-01"}):
        o = SearchOptions(**{"limit": 10, **options})
        assert listed(ranked_index.ranked_page(index, o)) == listed(search_page(corpus, o)), options


def test_resumed_pages_go_through_all(spark, built):
    _, _, cache, _, index = built
    corpus = refresh.read_cache(spark, cache)
    for options in ({"query": "an", "limit": 17},):
        o = SearchOptions(**options)
        want = listed(search_page(corpus, SearchOptions(**{**options, "limit": 10_000})))
        page = ranked_index.ranked_page(index, o).collect()
        got = [tuple(r[c] for c in COLUMNS) for r in page]
        for _ in range(2):
            page = ranked_index.ranked_after(index, o, ranked_index.token_of(page[-1])).collect()
            got += [tuple(r[c] for c in COLUMNS) for r in page]
        assert len(got) > 2 * o.limit or len(got) == len(want)
        assert got == want[:len(got)]
    last = ranked_index.ranked_page(index, SearchOptions(limit=10_000)).collect()[-1]
    assert ranked_index.ranked_after(index, SearchOptions(), ranked_index.token_of(last)).count() == 0


def opened(df):
    """Number of files of a table that are read."""
    return df.select(F.input_file_name()).distinct().count()


def test_a_deep_page_reads_as_much_as_the_first(spark, built, monkeypatch):
    """The rows that are read for a page lie in as many parts, wherever it is."""
    index, seen = built[4], []
    real = ranked_index._between

    def spy(df, bounds):
        out = real(df, bounds)
        seen.append(opened(out) if "content" in out.columns else 0)
        return out

    monkeypatch.setattr(ranked_index, "_between", spy)
    total = index.rows.count()
    sizes = []
    for offset in (0, total // 2, total - 10):
        seen.clear()
        assert ranked_index.ranked_page(index, SearchOptions(limit=10, offset=offset)).count() == 10
        sizes.append(seen[0])
    assert max(sizes) <= 3 < opened(index.rows)


def test_fingerprint_follows_the_files_and_a_stale_index_is_refused(spark, tmp_path):
    rng, root, cache, path = random.Random(8), str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "index")
    names = [f"{root}/{x}.jsonl" for x in "abcd"]
    for name in names:
        append(name, codex_lines(rng, 20, 0))
    refresh.refresh_corpus(spark, cache, [root])
    assert fingerprint.update_prints(spark, cache) == 4 and fingerprint.update_prints(spark, cache) == 0
    index = ranked_index.cached_index(spark, cache, path, build=True)
    before = ranked_index.ranked_page(index, SearchOptions(limit=1000)).count()

    def same():
        got = fingerprint.cache_fingerprint(spark, cache).first()
        assert (got["files"], got["fingerprint"]) == tuple(corpus_fingerprint(refresh.read_cache(spark, cache)).first())
        return got["fingerprint"], got["state"]

    first = same()
    for step in range(2):
        append(names[step], codex_lines(rng, 15, 50))  # grown
        with open(names[2], "w") as f:
            f.write("\n".join(codex_lines(rng, 7 + step, 90)) + "\n")  # replaced
        if step:
            os.remove(names[3])
        refresh.refresh_corpus(spark, cache, [root])
        assert fingerprint.update_prints(spark, cache) == 2
        assert same() != first
    with pytest.raises(ranked_index.StaleIndex):
        ranked_index.cached_index(spark, cache, path)
    assert ranked_index.ranked_page(index, SearchOptions(limit=1000)).count() == before  # a reader goes on with its build
    fresh = ranked_index.cached_index(spark, cache, path, build=True)
    assert fresh.rows.count() == refresh.read_cache(spark, cache).messages.count()
    snapshots.compact(spark, cache)
    assert fingerprint.update_prints(spark, cache) == 0
    ranked_index.cached_index(spark, cache, path)  # compaction makes nothing stale


def test_empty_corpus(spark, tmp_path):
    from logloom.schema import corpus_from_tables

    mark = ranked_index.write_ranked_index(corpus_from_tables(spark, {}), str(tmp_path))
    index = ranked_index.open_ranked_index(spark, str(tmp_path), mark)
    assert ranked_index.ranked_page(index, SearchOptions()).count() == 0
    assert ranked_index.ranked_page(index, SearchOptions(query="x", offset=3)).count() == 0


def test_message_index_has_no_folder_for_a_day(spark, tmp_path):
    import os

    from logloom.operators import search
    from logloom.schema import corpus_from_tables
    said = spark.createDataFrame([(f"f{i}", 1, 0, "s", "codex", "event_msg.user_message", "user", f"2026-01-{i:02d}T00:00:00Z", f"text {i}") for i in range(1, 29)],
                                 "file_path string, line long, seq int, session_id string, provider string, source_event string, role string, timestamp string, content string")
    path = str(tmp_path / "index")
    search.write_message_index(corpus_from_tables(spark, {"messages": said}), path)
    assert os.listdir(f"{path}/provider=codex") and not [n for n in os.listdir(f"{path}/provider=codex") if n.startswith("date_key=")]
    got = search.search_index(spark.read.parquet(path), search.SearchOptions(query="text", since="2026-01-27")).collect()
    assert [(r.date_key, r.snippet) for r in got] == [("2026-01-28", "text 28"), ("2026-01-27", "text 27")]
