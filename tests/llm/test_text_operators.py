"""Text operators against brute force, with the awkward rows: nulls, empty, long, tied and repeated ones, empty tables, clashing columns."""

import bisect
import hashlib
import random
import struct
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import bpe, chat, language_id, license_scan, packing, simhash, substring, url_filter
from logloom.llm.bktree import BKForest
from logloom.llm.common import CLEANUP, Staged
from logloom.llm.fm_index import FMIndex
from logloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = ("_r1", "_r2", "node", "rid", "component_id", "score", "lang_pred", "n_words", "spans", "_cid", "marked", "c0", "a.b", "sequence_id")


def docs(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES if clash else ())])


def awkward():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, long), (7, long), (7, long), (8, long + " end"), (None, "x y z"),
            (9, "A b C d"), (10, "a B c D"), (11, "\u00a0nbsp stays\u00a0in words"), (12, "日本語 テキスト"), (13, "a " * 500)]
    return rows + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(120)]


def components(nodes, linked):
    root = dict.fromkeys(nodes)
    for n in sorted(nodes):
        if root[n] is None:
            todo = [n]
            while todo:
                x = todo.pop()
                if root[x] is None:
                    root[x] = n
                    todo += [y for y in nodes if root[y] is None and linked(x, y)]
    return root


def print_of(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_exact(spark):
    rows = [(i, t) for i, t in awkward() if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    want = {i: print_of(t) for i, t in rows}
    root = components(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    found = simhash.near_duplicates(docs(spark, rows)).select("doc_id", "f0", "component_id").collect()
    assert {r[0]: (r[1] % 2**64, r[2]) for r in found} == {i: (want[i], root[i]) for i in want}


def test_simhash_blocks_lose_no_link(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:200 + rng.randrange(3)] + [f"z{rng.randrange(4)}"])) for i in range(300)]
    one = {r[0]: r[1] for r in simhash.near_duplicates(docs(spark, rows)).select("doc_id", "component_id").collect()}
    many = {r[0]: r[1] for r in simhash.near_duplicates(docs(spark, rows), block=7).select("doc_id", "component_id").collect()}
    assert one == many


def test_simhash_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    text = [f"word{rng.randrange(10_000)}" for _ in range(400)]
    near = text[:50] + ["changed"] + text[51:]
    other = [f"else{rng.randrange(10_000)}" for _ in range(400)]
    rows = [(5, " ".join(text)), (3, " ".join(near)), (3, " ".join(near)), (9, " ".join(other)), (None, " ".join(other)), (7, "")]
    df = docs(spark, rows)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r[0] is None, r[0]) for r in kept.select("doc_id").collect())[:3] in ([(False, 3), (False, 7), (False, 9)], [(False, 3), (False, 7), (True, None)])
    assert kept.count() == 3 and kept.select("spans").distinct().count() == 1


def test_similar_sets_against_brute_force(spark):
    """Links are exact in the sets of shingles: neither one hot shingle nor equal fingerprints drop a text."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    ruler = ["0"] * 400
    texts = [" ".join(ruler + words(40)) for _ in range(4)]
    texts += [" ".join(words(3) * 300 + words(20)) for _ in range(2)]
    template = words(30)
    texts += [" ".join(template + words(n)) for n in (4, 5, 6, 7, 8, 20) for _ in range(6)]  # Jaccard similarity of 0.76, ...
    for n in (8, 60, 500):
        base = words(n)
        texts += [" ".join(base), " ".join(base + words(1)), " ".join(words(1) + base + base[:5]), " ".join(base[: n - n // 8]), " ".join(base + base)]
    texts += ["", "   ", "one two", "One  TWO", "one three", "a b c d e", "a b c d e a b c d e"]
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = components(range(len(texts)), lambda a, b: sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))
    assert all(root[i] == i for i in range(6)) and len(set(root.values())) < len(texts) - 10
    df = docs(spark, list(enumerate(texts)))
    for block in (4096, 7):
        found = simhash.near_duplicates(df, simhash.similar_plan(), block).select("doc_id", "component_id", "first").collect()
        assert {r[0]: r[1] for r in found} == root
        assert sorted(r[0] for r in found if r[2]) == sorted(set(root.values()))
    assert sorted(r[0] for r in simhash.deduplicated(df).select("doc_id").collect()) == sorted(set(root.values()))


def test_similar_sets_give_rows_by_nodes_not_by_pairs(spark):
    """A group of texts that are alike but under the similarity: all are judged, but neither candidates nor links are listed by pair."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template = words(100)
    texts = [" ".join(template + words(22)) for _ in range(150)]  # a similarity of 0.69 each
    texts.append(f"{texts[70]} {' '.join(words(2))}")
    plan, n = simhash.similar_plan(), len(texts)
    nodes = simhash.fingerprints(docs(spark, list(enumerate(texts))), plan).withColumn("node", F.col("doc_id"))
    rows = docs(spark, list(enumerate(texts))).select("doc_id", "text").withColumns(simhash._row_keys("doc_id", "text"))
    for block in (4096, 40):
        near = simhash._laid(nodes, plan, block, Staged(spark)).mapInArrow(simhash._search(plan), "node long, root long")
        parts = -(-n // block)
        assert n <= near.count() <= len(plan.keys) * n * parts
        links = [tuple(r) for r in simhash._set_links(rows, nodes, plan, block, Staged(spark)).select("node", "root").collect()]
        assert {(max(x), min(x)) for x in links} == {(n - 1, 70)} and len(links) == 1


def test_staged_tables_leave_no_shuffle_files(spark):
    """Files of a shuffle go with the table that it was for, and the setting is as before."""
    before, env = spark.conf.get(CLEANUP), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {f.name for d in env.blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    held, until = files(), time.time() + 20
    made, _ = Staged(spark).table(spark.range(1000).repartition(4, "id"))
    while files() - held and time.time() < until:
        time.sleep(0.1)
    assert not files() - held
    assert made.count() == 1000 and spark.conf.get(CLEANUP) == before


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.deduplicated(docs(spark, [])).count() == 0


def test_bk_forest():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, (400, 1), dtype=np.uint64)
    prints[200:] = prints[:200] ^ (np.uint64(1) << rng.integers(0, 64, (200, 1), dtype=np.uint64))
    group = np.sort(rng.integers(0, 3, 400))
    group = np.unique(group, return_inverse=True)[1]
    pairs = set()
    for q, n in BKForest(prints, group).search(prints, group, 3, slice_rows=50):
        pairs |= set(zip(q.tolist(), n.tolist()))
    d = np.bitwise_count(prints ^ prints.T)
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(d <= 3)) if group[i] == group[j]}


def brute_windows(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window, crowd", [(35, 4096), (35, 2), (12, 4096)])
def test_substring(spark, window, crowd):
    rng = random.Random(window + crowd)
    shared = [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(4)] + ["x " * 150, "y z " * 40]
    rows = awkward() + [(1000 + i, " ".join(rng.choice(shared) if rng.random() < .5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 50)))
                                          for _ in range(rng.randrange(4)))) for i in range(80)]
    df = docs(spark, rows).withColumn("row", F.monotonically_increasing_id())
    got = substring.remove_repeats(df, window, crowd).orderBy("row").collect()
    by_row = [r["text"] for r in df.orderBy("row").collect()]
    for row, (n, removed, kept) in zip(got, brute_windows(by_row, window), strict=True):
        assert (row["n_words"], row["n_removed"]) == (n, removed)
        assert b" ".join((row["text"] or "").encode().split()) == kept
        assert row["spans"] == CLASHES.index("spans")
    assert got[0]["text"] is None


def test_substring_counts_places_not_texts(spark):
    """One text may elect a gram at any number of places; such a gram is crowded, and the result stays exact."""
    rng = random.Random(21)
    other = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    notice = other(40)
    texts = [" ".join(f"{other(rng.randrange(1, 30))} {notice}" for _ in range(60)), f"{other(50)} {notice} {other(50)}", "y " * 30_000, other(200)]
    df = docs(spark, list(enumerate(texts)))
    cids = df.select(substring.content_id(F.col("text")).alias("cid"), "text")
    substring.ship(spark)
    anchors = cids.mapInArrow(substring._anchors(35), "gram long, cid binary, lo long, hi long, n long").collect()
    anchors = spark.createDataFrame(anchors, "gram long, cid binary, lo long, hi long, n long")
    places = {r[0]: r[1] for r in anchors.groupBy("gram").agg(F.sum("n")).collect()}
    crowded = {r["gram"]: r["crowded"] for r in substring.repeated_grams(anchors, 50).collect()}
    assert any(crowded.values()) and all(c == (places[g] > 50) for g, c in crowded.items())
    got = substring.remove_repeats(df, 35, 50).orderBy("doc_id").collect()
    for r, (n, removed, kept) in zip(got, brute_windows(texts, 35)):
        assert (r["n_words"], r["n_removed"], r["text"].encode()) == (n, removed, kept if removed else r["text"].encode())



def test_substring_passage_of_many_texts(spark, monkeypatch):
    """Windows that are common in a crowded gram, others that only few texts share, and some that none does."""
    monkeypatch.setattr(substring, "FOLD", 100)
    rng = random.Random(22)
    other = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    passage, ends = other(45), [other(6) for _ in range(20)]
    texts = [f"{other(rng.randrange(60))} {rng.choice(ends)} {passage} {rng.choice(ends)} {other(rng.randrange(60))}" for _ in range(400)] + [f"{passage} {passage}"]
    got = substring.remove_repeats(docs(spark, list(enumerate(texts))), 35, 30).orderBy("doc_id").collect()
    for r, (n, removed, kept) in zip(got, brute_windows(texts, 35)):
        assert (r["n_words"], r["n_removed"], b" ".join(r["text"].encode().split())) == (n, removed, kept)


def test_substring_query_and_empty(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: (n, m, hashlib.sha256(k).hexdigest()) for r, (n, m, k) in zip(rows, brute_windows([r[1] for r in rows], 35))}
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op4_substring"](spark, SF).collect()} == want
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 300)
    text[::60] = 0
    text[-1] = 0
    index = FMIndex(text, 12)
    parts = ["".join(map(str, p)) for p in np.split(text, np.flatnonzero(text == 0)) if len(p)]
    for end in np.flatnonzero(text)[::7]:
        start = end
        while text[start - 1]:
            start -= 1
        own = "".join(map(str, text[start:end + 1]))
        best = max([k for k in range(1, min(12, len(own)) + 1) if sum(p.startswith(own[-k:], i) for p in parts for i in range(len(p))) > 1], default=0)
        assert index.matched(text, np.array([end]), 12)[0] == best


def test_bpe_matches_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "=", "==", "é", "日本", "<|endoftext|>", "'s", "'S", "1", "½", "\u3000", "👍", "\x85", "\x1c", "İ", "Ⅷ", "\x00"]
    texts = [None, "", " ", *["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(400)], "a" * 3000, "=" * 5000, "ab" * 2500, " " * 3000 + "x"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs(spark, rows), VOCABULARY), VOCABULARY).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", got[i]["ids"])) == ids
        assert got[i]["text"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs(spark, []), VOCABULARY).count() == 0


def test_bpe_streams_in_constant_memory():
    pairs = bpe.load(VOCABULARY)
    data = ("abacus" * 4000 + "=" * 3000).encode()
    whole = pairs._window(data)
    assert list(pairs.stream(data[i:i + 7] for i in range(0, len(data), 7))) == whole
    assert pairs.lookahead < 1000


def test_bpe_decodes_broken_characters():
    pairs = bpe.load(VOCABULARY)
    ids = b"".join(struct.pack("<I", pairs.ids[bytes([b])]) for b in b"\xe6\x97a\xff\xf0\x9f\x91\x8d\xe6")
    assert "".join(pairs.decode(ids, step=1)) == b"\xe6\x97a\xff\xf0\x9f\x91\x8d\xe6".decode("utf-8", "replace")


def test_packing_of_long_white_space(spark):
    pairs = bpe.load(VOCABULARY)
    texts = {1: " " * 2_000_000, 2: "\n" * 2_000_000, 3: "one" + " \n" * 1_000_000 + "two", 4: "short"}
    pieces = packing.pack_documents(docs(spark, list(texts.items())), VOCABULARY, with_ids=True).collect()
    got = {i: b"".join(p["ids"] for p in sorted(pieces, key=lambda p: p["piece"]) if p["doc_id"] == i)[:-4] for i in texts}
    assert got[1] == pairs.encode(" ") * 2_000_000 and got[2] == pairs.encode("\n" * 1000) * 2000
    assert all("".join(pairs.decode(got[i])) == t for i, t in texts.items())


def test_runs_of_white_space_keep_their_ids():
    packing._encoder(VOCABULARY)
    pairs, rng = bpe.load(VOCABULARY), random.Random(8)
    fast = packing.tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=pairs.ids, special_tokens=pairs.added)
    parts = ["a", "the", " ", "  ", "\n", "\t", "=", "é", "<|endoftext|>", "'s", "1", "\u3000", "\xa0", "\x85", "\x1c"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert packing._encode_runs(fast, pairs, text, rng.randrange(1, 5)) == pairs.encode(text) == packing._encode(fast, text)


def test_packing(spark):
    library = Tokenizer.from_file(VOCABULARY)
    rows = [r for r in awkward() if r[0] != 6]
    packed = packing.pack_documents(docs(spark, rows), VOCABULARY, with_ids=True)
    pieces = packed.collect()
    texts = Counter()
    for i, t in rows:
        texts[i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    by_doc = {}
    for p in sorted(pieces, key=lambda p: p["piece"]):
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] and 1 <= p["length"] <= 1024
        assert p["piece"] == 0 or p["length"] == 1024
        by_doc.setdefault(p["doc_id"], []).append(p)
    for (i, ids), copies in texts.items():
        own = by_doc[i]
        if copies == 1 and sum(k[0] == i for k in texts) == 1:
            assert b"".join(p["ids"] for p in own) == struct.pack(f"<{len(ids)}I", *ids)
            assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
    places = {}
    for p in pieces:
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == 4 * sum(p["length"] for p in pieces)
    assert packing.pack_documents(docs(spark, []), VOCABULARY).count() == 0


def test_packing_is_tight(spark):
    rows = QUERIES["op9_packing"](spark, "/root/testdata/sf0.01").select("sequence_id", "length").collect()
    gaps, made = [], 0  # best fit, largest first, over all rows at once
    for length in sorted((r[1] for r in rows), reverse=True):
        at = bisect.bisect_left(gaps, length)
        made += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else 1024
        bisect.insort(gaps, gap - length)
    assert len({r[0] for r in rows}) <= 1.02 * made


def test_sum_of_squares_takes_the_smallest_sum():
    packer, rng = packing.SumOfSquares(20), random.Random(0)
    for _ in range(300):
        length, count = rng.randrange(1, 21), packer.count.copy()
        def after(gap):
            now = count.copy()
            if gap < 20:
                now[gap] -= 1
            if gap > length:
                now[gap - length] += 1
            return int((now[1:20] ** 2).sum())
        options = [g for g in range(length, 20) if count[g]] + [20]
        packer.place(length)
        assert int((packer.count[1:20] ** 2).sum()) == min(map(after, options))


def test_language_id(spark):
    got = QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_language_id_awkward(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_id.train(train)
    assert model.languages == ("de", "en")
    df = docs(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (5, "und die"), (6, "the dog " * 50_000)])
    got = language_id.identify(df, model)
    assert got.columns == [c for c in df.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    assert [r[0] for r in got.orderBy("doc_id").select("lang_pred").collect()] == ["und", "und", "und", "en", "de", "en"]
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns and [r["score"] for r in kept.collect()] == [CLASHES.index("score")] * 3
    empty = language_id.train(train.where("false"))
    assert {r[0] for r in language_id.identify(df, empty).select("lang_pred").collect()} == {"und"}
    assert language_id.identify(docs(spark, []), model).count() == 0


def test_language_scores_match_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    codes, starts = language_id._codes(texts)
    for order in (1, 2, 3):
        grams = language_id._grams(codes, order, 1 << 10)
        for text, start in zip(texts, starts):
            own = grams[start: start + len(text) + 1]
            alone = language_id._grams(language_id._codes([text])[0], order, 1 << 10)
            assert own.tolist() == alone.tolist() and (own >= 0).sum() == max(0, len(text) - order + 1 + (order > 1))


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|x", "<|", None, "", "a\nb%0A", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"]
    rows = [(c, t, role, text) for c, text in enumerate(nasty) for t, role in enumerate(("user", "assistant"))]
    rows += [(50, 0, "assistant", "first"), (51, 0, "user", "q"), (51, 0, "user", "q"), (None, 1, None, "x"), (52, None, "odd\nrole%<|", "y"), (53, 0, "user", "long " * 100_000)]
    df = spark.createDataFrame(rows, TURNS).select("*", F.lit(1).alias("loss"), F.lit(2).alias("valid"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[conv]["n_turns"] == len(own)
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and got[conv]["loss_chars"] == len(learned)
    assert [got[c]["valid"] for c in (0, 50, 51, None)] == [True, False, False, False]
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


def test_chat_segments(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], TURNS)
    segments = chat.format_chats(df).orderBy("turn_no", "segment_no").collect()
    assert "".join(s["text"] for s in segments) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert [s["text"] for s in segments if s["loss"]] == ["yo"]


RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow")]


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/de/", "http://xexample.net/en/1", "http://net", "no scheme", None, "", "a://b://c/d", "x://h?p/q", "x://H#a", "x://É.net/\nq"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, link string").select("*", F.lit(1).alias("host"), F.lit(2).alias("_rule"), F.lit(3).alias("c0"))
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES, "link").collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(len(urls))] == [
        ("a.example.net", "/en/x"), ("example.net", "/de/"), ("xexample.net", "/en/1"), ("net", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("h", ""), ("h", ""), ("É.net", "/\nq")]
    assert [got[i]["rule"] for i in range(len(urls))] == ["example.net/en/", "net/", "net/", None, None, None, None, None, None, None, "net/"]
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "block", "allow"] and got[0]["_rule"] == 2 and got[0]["c0"] == 3
    assert url_filter.judge(df.where("false"), RULES, "link").count() == 0


def test_url_model_learns_and_matches_brute_force(spark):
    rng = random.Random(0)
    good, bad = ["news", "wiki", "docs"], ["casino", "pills", "spam"]
    rows = [(f"{rng.choice(good if i % 2 else bad)}{rng.randrange(30)}.com/{rng.randrange(500)}", "allow" if i % 2 else "block") for i in range(2000)]
    model = url_filter.fit(spark.createDataFrame(rows, "place string, label string"))
    fresh = [f"{w}{rng.randrange(1000)}.com/x" for w in good + bad]
    assert [d >= model.cut_off for d in url_filter.difference(model, fresh)] == [True] * 3 + [False] * 3

    def brute(m, text):
        data, total = text.encode() + b"\n", 0.0
        for i in range(len(data)):
            p = 1 / 256
            for size in range(1, m.order + 2):
                key = sum((data[i - b] if i >= b else 0) << 8 * b for b in range(size))
                table = dict(zip(m.grams[size - 1].tolist(), m.counts[size - 1].tolist()))
                context = dict(zip(m.contexts[size - 1].tolist(), zip(m.totals[size - 1].tolist(), m.kinds[size - 1].tolist())))
                if key >> 8 in context:
                    n, kinds = context[key >> 8]
                    p = (table.get(key, 0) + kinds * p) / (n + kinds)
            total += np.log(p)
        return total / len(data)

    for text in fresh[:3]:
        assert abs(brute(model.accepted, text) - brute(model.rejected, text) - url_filter.difference(model, [text])[0]) < 1e-9


def test_url_sample_is_the_smallest_hashes_of_distinct_urls(spark):
    rows = [(f"h{i % 700}/p", "allow" if i % 700 < 500 else "block") for i in range(3000)] + [("hot/x", "allow")] * 2000 + [(None, "allow"), ("h1/p", None), ("h1/p", "other")]
    df = spark.createDataFrame(rows, "place string, label string")
    hashed = df.where("place is not null").select("place", "label", F.xxhash64("place").alias("h")).distinct().collect()
    for sample in (1, 50, 10_000):
        want = {(r["place"], r["label"]) for x in ("allow", "block") for r in sorted((r for r in hashed if r["label"] == x), key=lambda r: (r["h"], r["place"]))[:sample]}
        got = [tuple(r) for r in url_filter.sampled(df, sample).collect()]
        assert len(got) == len(want) and set(got) == want
    assert url_filter.sampled(df.where("false"), 5).count() == 0


def test_licences(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [("r/LICENSE", mit), ("r/a.txt", "no words here"), ("r/s/b.txt", "text\n" + apache + "\nmore"), ("r/s/t/c.txt", None), ("r/u/COPYING.md", apache),
            ("r/u/v/d.txt", ""), ("q/e.txt", "x"), ("top.txt", mit), (None, mit), (None, "x"), ("r/u/v/LICENSE", "nothing known"), ("r/a.txt", "no words here"),
            ("r/long.txt", "by the way " * 100_000)]
    df = spark.createDataFrame(rows, "path string, text string").select("*", F.lit(7).alias("_folder"), F.lit(8).alias("license"))
    got = {(r["path"], r["text"]): (r["own_license"], r["license"], r["inherited_from"]) for r in license_scan.scan_licences(df).collect()}
    assert got["r/s/b.txt", rows[2][1]] == ("Apache-2.0", "Apache-2.0", None)
    assert got["r/a.txt", "no words here"] == (None, "MIT", "r") and got["r/s/t/c.txt", None] == (None, "MIT", "r")
    assert got["r/u/v/d.txt", ""] == (None, "Apache-2.0", "r/u") and got["q/e.txt", "x"] == (None, None, None)
    assert got[None, mit] == ("MIT", "MIT", None) and got[None, "x"] == (None, None, None)
    assert license_scan.scan_licences(df).count() == len(rows) and license_scan.scan_licences(df.where("false")).count() == 0


def test_licence_scores_do_not_depend_on_the_number_of_files(spark):
    """The same files a thousandfold get the scores that they get once."""
    texts = ["Released under the MIT License by Acme Corp.", "Licensed under the Apache License, Version 2.0 by Acme", "SPDX-License-Identifier: MIT", "plain words", None,
             "All rights reserved", "a licence text\nLicensed under CC BY 4.0", "version of the software"]
    df = spark.createDataFrame([(f"d{i}/f", t) for i, t in enumerate(texts)], "path string, text string")
    once = {r["text"]: (r["own_license"], r["own_score"]) for r in license_scan.scan_licences(df).collect()}
    many = license_scan.scan_licences(df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1000)))))
    rows = many.groupBy("text").agg(F.collect_set(F.struct(F.coalesce("own_license", F.lit("")), F.coalesce("own_score", F.lit(-1.0)))).alias("got"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["text"]: [tuple(x) for x in r["got"]] for r in rows} == {t: [(a or "", -1.0 if b is None else b)] for t, (a, b) in once.items()}
    assert all(r["n"] == 1000 for r in rows) and once["All rights reserved"] == ("Proprietary", 1.0)
    assert once[texts[0]][0] == "MIT" and once[texts[1]][0] == "Apache-2.0"


def test_licence_query_is_native(spark):
    plan = QUERIES["op6_license_scan"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "op6_license_scan" in ORACLE


def test_url_model_reads_every_labelled_url(spark, monkeypatch):
    rows = [(f"good.org/{i:x}/read", "allow") for i in range(24_000)] + [(f"bad.net/{i:x}/buy", "block") for i in range(24_000)]
    df = spark.createDataFrame(rows + rows[:5], "place string, label string").repartition(4)
    model = url_filter.fit(df)
    fitted = {label: df.where(f"label = '{label}'").distinct().where("pmod(xxhash64(place, 1), 5) <> 0").count() for label in ("allow", "block")}
    ends = [int(m.counts[0][m.grams[0] == ord("\n")][0]) for m in (model.accepted, model.rejected)]
    assert ends == [fitted["allow"], fitted["block"]]  # 20 000 of each class before
    monkeypatch.setattr(url_filter, "KEYS", 100)
    small = url_filter.fit(df)
    assert small.accepted.hashed and not model.accepted.hashed and all(c.max() < 1 << 14 for c in small.rejected.contexts[3:])
    assert [int(m.counts[4].sum()) for m in (small.accepted, model.accepted)] == [int(model.accepted.counts[0].sum())] * 2
    assert (url_filter.difference(small, ["good.org/zz/read", "bad.net/zz/buy"]) >= small.cut_off).tolist() == [True, False]
