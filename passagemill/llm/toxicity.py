"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours and pairs with one word between, hashed to
2**20 places. Each weight has its own learning rate, alpha / (beta + root of its squared gradients),
and is exactly zero until its gradients outweigh L1; so the weights that are left are few. They are
at most 2**20 pairs of numbers whatever the corpus, which is the bound under which they are broadcast.

The model is fitted on a bounded sample: the ``train_rows`` labelled rows of least hash. One task
streams it in a set order, a document at a time, so its memory is that of the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BoundedCache, GOLDEN, mix, stage

BITS = 20
TRAIN_ROWS, EPOCHS = 20_000, 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
#: ASCII other than letters and digits parts words; A-Z is lowered.
WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

_MEMO: BoundedCache | None = None


def _hashes() -> BoundedCache:
    """The memo of a Python worker."""
    global _MEMO
    if _MEMO is None:
        from xxhash import xxh64_intdigest

        _MEMO = BoundedCache(xxh64_intdigest, 200_000)
    return _MEMO


def features(text: str | None) -> np.ndarray:
    """The distinct places of a text's features; place 0 is the bias, which every text has."""
    words = text.encode().translate(WORD).split() if text else []
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        grams = [mix(h), mix(h[:-1] * GOLDEN + h[1:]), mix(h[:-2] * GOLDEN + h[2:] + np.uint64(1))]
    places = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.unique(np.append(places, 0))


class Ftrl:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 0, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.n[at] = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at]) - np.sqrt(n)) / self.alpha * w

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((np.abs(self.z) > self.l1) | (np.arange(1 << BITS) == 0))
        return at, self.weights(at)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            model.learn(features(text.as_py()), label)
    at, w = model.sparse()
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["place", "weight"])


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """Weights (place, weight) learnt from labels(doc_id, label 0 or 1) and documents(doc_id, text).

    Null ids and labels are left out; a doc_id with both labels counts as 1. Without any labelled
    document there are no weights but the bias, and every score is a half.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.orderBy(*order).limit(train_rows)
    # At most train_rows rows of two numbers.
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    one = rows.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", "epoch"), "doc_id", "text")
    return stage(one.select("text", "label").mapInArrow(_fit, "place long, weight double"), "toxicity-weights")


def _scored(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        at, values = weights.value
        w[at] = values
        for batch in batches:
            raw = np.array([w[features(text.as_py())].sum() for text in batch.column(batch.num_columns - 1)])
            score = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def score(documents: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, score) for each row of documents(doc_id, text); a null text is scored by the bias alone.

    Null and repeated doc_ids keep one row each; an empty table gives none. Other columns are not read.
    """
    rows = weights.collect()  # at most 2**20, and few after L1
    values = np.array([r.place for r in rows], np.int64), np.array([r.weight for r in rows])
    shared = documents.sparkSession.sparkContext.broadcast(values)
    return documents.select("doc_id", "text").mapInArrow(_scored(shared), "doc_id long, score double")


def held_out(modulus: int = 5, held: int = 0):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == held


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that has seen no held-out row's label."""
    known = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    rows = score(documents, fit(documents, known))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
