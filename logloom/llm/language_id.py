"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language over all labelled rows: every task adds up one matrix (hash buckets x languages) and sends only
its non-zero cells, which an aggregate sums.  The log-probability matrix has a fixed number of buckets and a column per
language, so its size does not grow with the rows; it is broadcast and texts are scored in numpy, a slice of a batch at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when there was nothing to
learn from.  Equal scores go to the smaller language name.  Training rows with a null text or language teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from logloom.llm.common import aside, own_columns, ship, slices

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``weights[bucket, language]`` are log probabilities; ``prior[language]`` too."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, a zero before each; the start of each text."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(low)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, low), np.int64, len(low)) + 1
    return codes, np.cumsum(lengths) - lengths


def _grams(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Hash bucket of the n-gram that ends at each position; -1 where it would hold more than the mark before its text."""
    n = len(codes)
    value, crosses = np.zeros(n, np.uint64), np.zeros(n, bool)
    for back in range(order):
        value[back:] = value[back:] * np.uint64(0x9E3779B97F4A7C15) + codes[: n - back] + np.uint64(order)
        value[back:] ^= value[back:] >> np.uint64(29)
        if back < order - 1:
            crosses[back:] |= codes[: n - back] == 0
    crosses[: order - 1] = True
    out = ((value * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
    out[crosses | (codes == 0)] = -1
    return out


def _count(orders: tuple[int, ...], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                by: dict[str, list[str]] = {}
                for text, lang in zip(texts, langs):
                    by.setdefault(lang, []).append(text)
                for lang, own in by.items():
                    codes, _ = _codes(own)
                    cells = total.setdefault(lang, np.zeros(buckets, np.int64))
                    for order in orders:
                        grams = _grams(codes, order, buckets)
                        cells += np.bincount(grams[grams >= 0], minlength=buckets)
                    rows[lang] = rows.get(lang, 0) + len(own)
        for lang, cells in total.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "bucket": [-1], "n": [rows[lang]]}, schema=_CELLS)
            for i in range(0, len(at), 1 << 15):
                some = at[i : i + (1 << 15)]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "bucket": some, "n": cells[some]}, schema=_CELLS)

    return run


_CELLS = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])


def train(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, smoothing: float = 0.5) -> LanguageModel:
    """Learn from the columns ``text`` and ``lang`` of all rows.

    ``buckets`` is a power of two.  The driver holds ``buckets`` x languages numbers, whatever the number of rows.
    """
    ship(docs.sparkSession)
    labelled = own_columns(docs, text="text", lang="lang").where("text is not null and lang is not null")
    cells = (labelled.mapInArrow(_count(orders, buckets), "lang string, bucket long, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    found = sorted(set(cells.column("lang").to_pylist()))
    column = {x: i for i, x in enumerate(found)}
    counts, rows = np.zeros((buckets, len(found))), np.ones(len(found))
    at = np.fromiter((column[x] for x in cells.column("lang").to_pylist()), np.int64, cells.num_rows)
    bucket, n = cells.column("bucket").to_numpy(), cells.column("n").to_numpy()
    counts[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    rows[at[bucket < 0]] = n[bucket < 0]
    weights = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * buckets)
    return LanguageModel(tuple(found), weights.astype(np.float32), np.log(rows / max(1.0, rows.sum())), orders)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; sums go over the n-grams each text has."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    which = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
    if not which:
        return names, scores
    codes, starts = _codes([texts[i] for i in which])
    sums = np.tile(model.prior, (len(which), 1))
    pad = np.vstack([model.weights, np.zeros((1, len(model.languages)), np.float32)])
    for order in model.orders:
        sums += np.add.reduceat(pad[_grams(codes, order, len(model.weights))], starts, axis=0, dtype=np.float64)
    best = sums.argmax(1)
    odds = np.exp(sums - sums.max(1, keepdims=True))
    share = odds[np.arange(len(which)), best] / odds.sum(1)
    for k, i in enumerate(which):
        names[i], scores[i] = model.languages[best[k]], float(share[k])
    return names, scores


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with two columns: ``lang_pred`` and ``score`` (the posterior of that language, 0 to 1).

    Columns of these names in ``docs`` are replaced.  Only ``text`` is an input of the prediction.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    text = f"c{kept.columns.index('text')}"
    placed = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])  # names with dots or repeated ones stay out of the map
    schema = StructType([*placed.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                names, scores = score_texts(held.value, part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[*part.schema.names, "lang_pred", "score"])

    return placed.mapInArrow(run, schema).toDF(*kept.columns, "lang_pred", "score")


def accepted(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a language and a posterior of at least ``min_score``; their columns are unchanged."""
    placed = aside(docs, "text")
    kept = identify(placed, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*placed.columns).toDF(*docs.columns)


def held_out(doc_id: Column) -> Column:
    """One row in four is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
