"""Substring dedup: every word covered by a window of ``window`` words that also starts anywhere else goes.

1. Each window elects the smallest hash among its word 8-grams (all of them, if equal); equal windows elect equal grams.  Only grams
   that are elected at two places or more in the corpus can stand in a repeated window.
2. For such grams, the stretch of text whose windows elected them is sent to the shard of the gram.  Equal windows meet in one shard.
3. A shard builds a compressed FM-index over its stretches (those of one text that overlap are joined first, so a place counts once) and streams
   them through it: backward search gives the length of the longest sequence ending at a word that the index holds twice, and ends
   where it reaches the window report an interval.
4. Intervals are brought back to the texts.

A gram that is elected at more than ``crowd`` places, in many texts or often in one, would make a shard that grows with the corpus.  Its equal
stretches are repeated as a whole, and the windows of the others are counted by content, which is exact as well; windows that are common in the gram
are few, go to all parts of it and mark intervals there.  Shards are otherwise bounded by the rows of a batch and ``crowd``.

Texts are told apart by 128 bits of their SHA-256, so copies are read once, and all windows of a text that comes twice are repeated.

Defined results: words are split at ASCII white space and compared unchanged; a null text has none; texts with fewer words than the
window stay whole; repeated rows are places of their own; windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from logloom.llm.common import Staged, own_columns, ship, slices, whole_groups
from logloom.llm.fm_index import FMIndex

GRAM = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def gram_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each 8-gram."""
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        step *= 2
    return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values in a row."""
    step, now = 1, values
    while 2 * step <= width:
        now = pick(now[:-step], now[step:])
        step *= 2
    return pick(now[: len(values) - width + 1], now[width - step: width - step + len(values) - width + 1]) if step < width else now


def elected(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the grams that a window elects: the smallest in it, or as small."""
    width = window - GRAM + 1
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(grams == _sliding(np.concatenate([edge, _sliding(grams, width, np.minimum), edge]), width, np.maximum))


def electors(grams: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows that elect each position; they are neighbours."""
    width = window - GRAM + 1
    least = _sliding(grams, width, np.minimum)
    start = at[:, None] + np.arange(1 - width, 1)
    elect = (start >= 0) & (start < len(least)) & (least[np.clip(start, 0, len(least) - 1)] == grams[at][:, None])
    return at - width + 1 + elect.argmax(1), at - elect[:, ::-1].argmax(1)


def _anchors(window: int):
    schema = pa.schema([("gram", pa.int64()), ("cid", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, cids, lows, highs, counts = [], [], [], [], []
                for cid, text in zip(part.column("cid").to_pylist(), part.column("text").to_pylist()):
                    words = words_of(text)
                    if len(words) < window:
                        continue
                    hashes = gram_hashes(words)
                    gram, n = np.unique(hashes[elected(hashes, window)], return_counts=True)
                    place = np.uint64(xxh64_intdigest(cid))
                    grams.append(gram)
                    cids += [cid] * len(gram)
                    lows.append(np.full(len(gram), place))
                    highs.append(np.where(n > 1, place + np.uint64(1), place))  # twice in one text: two places
                    counts.append(n)
                if cids:
                    flat = [np.concatenate(x) for x in (grams, lows, highs, counts)]
                    yield pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(cids, pa.binary()), pa.array(flat[1].view(np.int64)),
                                                      pa.array(flat[2].view(np.int64)), pa.array(flat[3])], schema=schema)

    return run


_STRETCHES = "gram long, crowded boolean, cid binary, first long, last long, words binary"


def _stretches(window: int):
    schema = pa.schema([("gram", pa.int64()), ("crowded", pa.bool_()), ("cid", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[] for _ in range(6)]
                for cid, text, grams in zip(*(part.column(c).to_pylist() for c in ("cid", "text", "grams"))):
                    if cid == before:  # copies lie side by side; those that do not are joined in their shard
                        continue
                    before, words = cid, words_of(text)
                    wanted = {g["gram"]: g["crowded"] for g in grams}
                    gram = gram_hashes(words)
                    at = elected(gram, window)
                    at = at[np.isin(gram[at].view(np.int64), np.fromiter(wanted, np.int64, len(wanted)))]
                    open_: dict[int, list] = {}
                    for g, a, b in zip(gram[at].view(np.int64).tolist(), *(x.tolist() for x in electors(gram, at, window))):
                        if g in open_ and a <= open_[g][1] + 1:
                            open_[g][1] = max(open_[g][1], b)
                            continue
                        if g in open_:
                            _put(out, g, wanted[g], cid, *open_[g], words, window)
                        open_[g] = [a, b]
                    for g, (a, b) in open_.items():
                        _put(out, g, wanted[g], cid, a, b, words, window)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return run


def _put(out: list[list], gram: int, crowded: bool, cid: bytes, first: int, last: int, words: list[bytes], window: int) -> None:
    for column, value in zip(out, (gram, crowded, cid, first, last, b" ".join(words[first: last + window]))):
        column.append(value)


_FOUND = pa.schema([("cid", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])


def shard_intervals(cids: list[bytes], firsts: list[int], lasts: list[int], texts: list[bytes], window: int) -> list[tuple[bytes, int, int]]:
    """Intervals [start, stop) of the texts that windows of one shard's stretches cover, where the shard holds them twice."""
    rows = sorted(range(len(cids)), key=lambda i: (cids[i], firsts[i], lasts[i]))
    ids: dict[bytes, int] = {}
    flat: list[int] = []
    base = np.zeros(len(cids), np.int64)  # where word 0 of a row's text would lie in the shard
    now, reach = None, 0
    for i in rows:
        own = [ids.setdefault(w, len(ids) + 1) for w in texts[i].split()]
        if cids[i] != now or firsts[i] >= reach:
            flat.append(0)
            base[i] = len(flat) - firsts[i]
            flat += own
            now, reach, last_base = cids[i], firsts[i] + len(own), base[i]
        else:
            base[i] = last_base
            flat += own[reach - firsts[i]:]
            reach = max(reach, firsts[i] + len(own))
    text = np.array([*flat, 0], np.int64)
    index = FMIndex(text, window)
    # queries: up to ``window`` - GRAM + 1 window ends of one row, so that the windows of a query all overlap
    row, lo, hi = [], [], []
    step = window - GRAM + 1
    for i in rows:
        for a in range(firsts[i], lasts[i] + 1, step):
            row.append(i)
            lo.append(a)
            hi.append(min(a + step - 1, lasts[i]))
    row, lo, hi = np.array(row), np.array(lo), np.array(hi)
    at, first = lo.copy(), np.full(len(row), -1)
    live = np.arange(len(row))
    while len(live):  # the first repeated window; a mismatch at f rules out all windows that hold f and the end tried
        end = base[row[live]] + at[live] + window - 1
        length = index.matched(text, end, window)
        good = length == window
        first[live[good]] = at[live[good]]
        at[live] += window - length
        live = live[~good & (at[live] <= hi[live])]
    live = np.flatnonzero(first >= 0)
    at, last = hi.copy(), np.full(len(row), -1)
    while len(live):  # the last one
        end = base[row[live]] + at[live] + window - 1
        good = index.matched(text, end, window) == window
        last[live[good]] = at[live[good]]
        live = live[~good]
        at[live] -= 1
    return [(cids[row[i]], int(first[i]), int(last[i]) + window) for i in np.flatnonzero(first >= 0)]


def _shards(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["gram"]):
            found = shard_intervals(*(table.column(c).to_pylist() for c in ("cid", "first", "last", "words")), window)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _FOUND.types)], schema=_FOUND)

    return run


def window_keys(first: int, last: int, text: bytes, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """128-bit hashes of the windows that start at ``first`` to ``last`` of a text that begins at ``first``, with the start of each part; a stretch may be as
    long as a text, so its windows come in parts."""
    words = text.split()
    for lo in range(first, last + 1, 10_000):
        yield lo, [hashlib.blake2b(b" ".join(words[k - first: k - first + window]), digest_size=16).digest() for k in range(lo, min(lo + 10_000, last + 1))]


#: Windows whose counts a task folds at once.
FOLD = 50_000


def _windows(window: int):
    """Counts of the windows of stretches, folded in the task: a window that many stretches hold is one row of it."""
    schema = pa.schema([("gram", pa.int64()), ("key", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary()), ("n", pa.int64())])

    def rows(held: dict) -> pa.RecordBatch:
        grams, keys = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((grams, keys, *zip(*held.values())), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        for batch in batches:
            for gram, cid, first, last, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "cid", "first", "last", "words"))):
                for lo, keys in window_keys(first, last, text, window):
                    for start, key in enumerate(keys, lo):
                        spot = cid + start.to_bytes(8)
                        old = held.setdefault((gram, key), [spot, spot, 0])
                        old[:] = min(old[0], spot), max(old[1], spot), old[2] + 1
                    if len(held) >= FOLD:
                        yield rows(held)
                        held = {}
        if held:
            yield rows(held)

    return run


def _marked(window: int):
    """Intervals of stretches, sorted behind the common windows of their gram and part; and each of their other windows, under its key."""
    schema = pa.schema([*_FOUND, ("gram", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, common = None, set()
        for batch in batches:
            found: list[tuple] = []
            for gram, part, key, cid, first, last, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "part", "key", "cid", "first", "last", "words"))):
                if (gram, part) != now:
                    now, common = (gram, part), set()
                if key is not None:
                    common.add(key)
                    continue
                for lo, keys in window_keys(first, last, text, window):
                    hit = np.fromiter((k in common for k in keys), bool, len(keys))
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    found += [(cid, lo + int(a), lo + int(b) - 1 + window, gram, None) for a, b in zip(edges[::2], edges[1::2])]
                    found += [(cid, lo + int(i), lo + int(i) + window, gram, keys[i]) for i in np.flatnonzero(~hit)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return run


def content_id(text: Column) -> Column:
    """128 bits of the text's SHA-256; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _crowded(stretches: DataFrame, window: int, crowd: int, staged: Staged) -> DataFrame:
    """Intervals of crowded stretches: equal stretches are repeated as a whole, of different ones the windows are counted.

    A gram is dealt into parts of about ``crowd`` stretches.  Windows with 64 copies or more for each part are common: there are at most
    ``crowd`` * 28 / 64 of them for a gram, whatever its size.  They go to every part, where stretches are marked by intervals.  What else is repeated has a
    small share of its gram's windows for each key, and is joined.
    """
    place, digest = F.struct("cid", F.col("first").alias("start")), F.unhex(F.substring(F.sha2("words", 256), 1, 32))
    told = stretches.withColumn("content", digest)
    contents = told.groupBy("gram", "content").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.first("words").alias("words"), F.min(F.col("last") - F.col("first")).alias("more"))
    contents, _ = staged.table(contents)
    whole = told.join(contents.where("lo != hi").select("gram", "content"), ["gram", "content"], "left_semi").select("cid", F.col("first").alias("start"), (F.col("last") + window).alias("stop"))
    places = contents.select("gram", "lo.cid", F.col("lo.start").alias("first"), (F.col("lo.start") + F.col("more")).alias("last"), "words", (F.col("lo") == F.col("hi")).alias("once"))
    windows = places.drop("once").mapInArrow(_windows(window), "gram long, key binary, lo binary, hi binary, n long")
    counts = windows.groupBy("gram", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    width = window - GRAM + 1
    parts, _ = staged.table(contents.groupBy("gram").agg(F.ceil(F.sum(F.col("more") + 1) / (crowd * width)).cast("int").alias("parts")))
    twice, _ = staged.table(counts.where("lo != hi").join(parts, "gram").select("gram", "key", "parts", (F.col("n") >= 64 * F.col("parts")).alias("common")))
    none = {c: F.lit(None).cast(t) for c, t in (("key", "binary"), ("cid", "binary"), ("first", "bigint"), ("last", "bigint"), ("words", "binary"))}
    common = twice.where("common").select("gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", *[none[c].alias(c) for c in ("cid", "first", "last", "words")])
    dealt = places.where("once").join(parts, "gram").select(
        "gram", F.pmod(F.xxhash64("cid", "first"), F.col("parts")).cast("int").alias("part"), none["key"].alias("key"), "cid", "first", "last", "words")
    laid = common.unionAll(dealt).repartition("gram", "part").sortWithinPartitions("gram", "part", F.col("key").isNull())
    marked, _ = staged.table(laid.mapInArrow(_marked(window), "cid binary, start long, stop long, gram long, key binary"))
    few = marked.where("key IS NOT NULL").join(twice.where("not common").select("gram", "key"), ["gram", "key"], "left_semi")
    columns = ["cid", "start", "stop"]
    return whole.unionByName(few.select(columns)).unionByName(marked.where("key IS NULL").select(columns))


def repeated_grams(anchors: DataFrame, crowd: int) -> DataFrame:
    """(gram, crowded): grams that are elected twice; crowded are those elected at more than ``crowd`` places, however few texts these lie in."""
    return (anchors.groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
            .where("lo != hi").select("gram", (F.col("n") > crowd).alias("crowded")))


def repeated_intervals(docs: DataFrame, window: int, crowd: int, staged: Staged) -> DataFrame:
    """(cid, spans): for each text with repeated windows, [start, stop) of its words; spans are null where the text itself comes twice."""
    ship(docs.sparkSession)
    texts = own_columns(docs, text="text").select(content_id(F.col("text")).alias("cid"), F.coalesce("text", F.lit("")).alias("text"))
    anchors, anchors_at = staged.table(texts.mapInArrow(_anchors(window), "gram long, cid binary, lo long, hi long, n long"))
    wanted = anchors.select("gram", "cid").join(repeated_grams(anchors, crowd), "gram").groupBy("cid").agg(F.collect_set(F.struct("gram", "crowded")).alias("grams"))
    stretches, _ = staged.table(texts.join(wanted, "cid").select("cid", "text", "grams").mapInArrow(_stretches(window), _STRETCHES))
    staged.drop(anchors_at)
    columns = ["gram", "cid", "first", "last", "words"]
    calm = stretches.where("not crowded").select(*columns).repartition("gram").sortWithinPartitions("gram", "cid", "first")
    found = calm.mapInArrow(_shards(window), "cid binary, start long, stop long")
    spans = found.unionByName(_crowded(stretches.where("crowded"), window, crowd, staged)).groupBy("cid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    copies = texts.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cid", F.lit(True).alias("copied"))
    both = spans.join(copies, "cid", "full").select("cid", F.when(F.col("copied"), F.lit(None)).otherwise(F.col("spans")).alias("spans"), F.lit(True).alias("marked"))
    return staged.table(both)[0]


def kept_words(text: str | None, marked: bool | None, spans: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and those that stay."""
    words = words_of(text)
    if not marked or len(words) < window:
        return len(words), words
    if spans is None:
        return len(words), []
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["stop"]] -= 1
    return len(words), [w for w, n in zip(words, np.cumsum(gone).tolist()) if not n]


def remove_repeats(docs: DataFrame, window: int = 35, crowd: int = 8192) -> DataFrame:
    """``docs`` with ``text`` cut to the words that stay, joined by blanks, and the columns ``n_words`` and ``n_removed`` (replaced if there).

    A text that loses nothing is unchanged, white space included; a null text stays null.
    """
    staged = Staged(docs.sparkSession)
    marks = repeated_intervals(docs, window, crowd, staged)
    own = docs.drop("n_words", "n_removed")
    n, at = len(own.columns), own.columns.index("text")
    placed = own.toDF(*[f"c{i}" for i in range(n)]).withColumn("_cid", content_id(F.col(f"c{at}")))
    joined = placed.join(marks.withColumnRenamed("cid", "_cid"), "_cid", "left").select(*[f"c{i}" for i in range(n)], "marked", "spans")
    schema = StructType([*[StructField(f.name, StringType() if i == at else f.dataType) for i, f in enumerate(placed.schema.fields[:n])],
                         StructField("n_words", LongType()), StructField("n_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                texts, words, removed = [], [], []
                for text, marked, spans in zip(*(part.column(c).to_pylist() for c in (f"c{at}", "marked", "spans"))):
                    total, kept = kept_words(text, marked, spans, window)
                    texts.append(text if len(kept) == total else b" ".join(kept).decode("utf-8", "surrogatepass"))
                    words.append(total)
                    removed.append(total - len(kept))
                columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64())],
                                                 names=[f"c{i}" for i in range(n)] + ["n_words", "n_removed"])

    return joined.mapInArrow(run, schema).toDF(*own.columns, "n_words", "n_removed")
