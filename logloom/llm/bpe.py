"""BPE encoding and decoding as streaming transducers.

Encoding: a piece of text is read left to right into a window.  Whether a token at the window's start is final depends on a bounded number of
bytes to its right, the merge list's sufficient lookahead; tokens that end at least that far before the end of the window are emitted, and
the window moves on, so memory is constant in the length of a piece.  The merge list's bound is computed once:
a rule (u, v) can only be spoiled by a better rule (a, b) whose ``a`` is a token on the right edge of ``v``, which in turn needs ``b`` to its right to
be formed, and so on with ever better rules.

Decoding: token ids become bytes, and an incremental byte-to-text machine emits characters as soon as they are complete.

The vocabulary comes from a tokenizer file (byte-level BPE, JSON) whose path is a parameter.  Added tokens in a text are found first
and get their own ids.  Texts are pre-split by the usual byte-level pattern.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import own_columns, ship, slices

# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of each memo of a worker; a full one starts anew.
MEMO = 400_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a token's start within which its tokens are decided, for merges in order of rank.

    ``right[t]``: the tokens on the right edge of t, t itself included, as its own merge made it.  ``need[a]``: the most bytes after a token ``a`` that
    decide whether one of the rules so far takes it as a left part.
    """
    right: dict[bytes, tuple[bytes, ...]] = {bytes([b]): (bytes([b]),) for b in range(256)}
    need: dict[bytes, int] = {}
    most = 1
    for u, v in merges:
        edge = right.get(v, (v,))
        here = len(v) + max([need.get(a, 0) for a in edge])
        need[u] = max(need.get(u, 0), here)
        most = max(most, len(u) + here)
        right.setdefault(u + v, (u + v, *edge))
    return most


class BytePairs:
    """The transducer of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        raw, model = byte_characters(), spec["model"]
        to_bytes = lambda t: bytes(raw[c] for c in t)
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(map(to_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.ranks = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.lookahead = lookahead(pairs)
        made = [self.ids[u + v] for u, v in pairs]
        self.ranked = made == sorted(made) and min(made, default=256) > max(self.ids[bytes([b])] for b in range(256))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.single = [bytes([b]) for b in range(256)]
        self.packed = {t: struct.pack("<I", i) for t, i in self.ids.items()}
        self.split = regex.compile(PATTERN).findall
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}

    def _window(self, window: bytes) -> list[bytes]:
        """Merge a window's bytes: the best rank first, the leftmost of equal ones."""
        ranks, single = self.ranks, self.single
        parts = [single[b] for b in window]
        found = [ranks.get(p, 1 << 30) for p in zip(parts, parts[1:])]
        while found and (best := min(found)) < 1 << 30:
            i = found.index(best)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), 1 << 30)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), 1 << 30)
        return parts

    def stream(self, data: Iterator[bytes]) -> Iterator[bytes]:
        """Tokens of one piece that arrives in parts; at most twice the lookahead and one part are held."""
        window = b""
        for part in data:
            window += part
            while len(window) > 2 * self.lookahead:
                some, at = window[: 2 * self.lookahead], 0
                for token in self._window(some):
                    if at + self.lookahead > len(some):
                        break
                    yield token
                    at += len(token)
                window = window[at:]
        yield from self._window(window)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-split piece as little-endian unsigned 32-bit integers; remembered while the memo has room."""
        known = self.pieces.get(piece)
        if known is None:
            data, packed = piece.encode("utf-8", "surrogatepass"), self.packed
            if data in packed and len(data) == 1:
                known = packed[data]
            else:
                tokens = self._window(data) if len(data) <= 2 * self.lookahead else self.stream(data[i: i + 4096] for i in range(0, len(data), 4096))
                known = b"".join([packed[t] for t in tokens])
            if len(piece) <= 32:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a blank and ``chunk``; None where the blank may belong to more white space around it."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            known = None
        else:
            known = b"".join(map(self.encode_piece, self.split(" " + chunk)))
        if len(chunk) <= 32:
            if len(self.chunks) >= MEMO:
                self.chunks.clear()
            self.chunks[chunk] = known
        return known

    def _plain(self, text: str) -> bytes:
        """A blank between two characters that are no white space always starts a piece, so texts are cut there first."""
        first, *chunks = text.split(" ")
        if chunks and first and not first[-1].isspace():
            known, out = self.chunks, [b"".join(map(self.encode_piece, self.split(first)))]
            for chunk in chunks:
                ids = known.get(chunk) or self._chunk(chunk)
                if ids is None:
                    break
                out.append(ids)
            else:
                return b"".join(out)
        return b"".join(map(self.encode_piece, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.at_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.added[p]) if p in self.added else self._plain(p) for p in self.at_added.split(text))

    def decode(self, ids: bytes, step: int = 1 << 16) -> Iterator[str]:
        """Text of packed ids, bit by bit; bytes that are no UTF-8 become U+FFFD, a character that is cut off waits for its rest."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.by_id
        view = memoryview(ids).cast("I") if ids else ()
        for i in range(0, len(view), step):
            yield machine.decode(b"".join(map(table.__getitem__, view[i: i + step])))
        yield machine.decode(b"", True)


_LOADED: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    """The transducer of a file, once per process."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text as packed unsigned 32-bit integers; a null text is empty.

    ``vocabulary`` is a path that every executor has.  Reads ``doc_id`` and ``text``; one row out for each row in.
    """
    ship(docs.sparkSession)
    rows = own_columns(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = load(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [transducer.encode(t) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text) for rows of (doc_id, ids)."""
    ship(coded.sparkSession)
    rows = own_columns(coded, doc_id="doc_id", ids="ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = load(vocabulary)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 22):
                texts = ["".join(transducer.decode(x)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of (doc_id, ids, text), one row each."""
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
