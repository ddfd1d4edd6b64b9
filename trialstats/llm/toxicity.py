"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every text becomes the set of its hashed lower-case words (without punctuation
at their ends), their stems of four and five bytes, word pairs and pairs with
one word between.  Training reads at
most `max_rows` labelled texts in hash order, in one task, with a learning rate
per coordinate and an L1 penalty that leaves most weights at zero; the non-zero
weights (at most 2**BITS) are broadcast and every whole text is scored.

Defined cases: null and empty texts score the bias alone; repeated rows score
alike, one row out for each row in; no usable label gives 0.5 everywhere; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from trialstats.llm.labelled import held_out, training_rows
from trialstats.llm.words import hashed, mix, pieces, words

BITS = 20
STEMS = (4, 5)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"'()[]")] = True


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word, stem, pair and skip pair; repeats included."""
    w = words(texts, lower=True)
    if not len(w.start):
        return w.row, np.zeros(0, np.int32)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        end -= (end - start > 1) & _PUNCTUATION[w.data[end - 1]]
        start += (end - start > 1) & _PUNCTUATION[w.data[start]]
    h = hashed(w.data, start, end)
    rows, slots = [w.row], [h]
    for size in STEMS:
        long = np.flatnonzero(end - start > size)
        rows.append(w.row[long])
        slots.append(hashed(w.data, start[long], start[long] + size, seed=size))
    for gap, salt in ((1, 0x51ED27), (2, 0xA1F00D)):
        if len(h) > gap:
            same = w.row[gap:] == w.row[:-gap]
            pair = mix(h[:-gap] * np.uint64(3) + h[gap:] + np.uint64(salt))
            rows.append(w.row[:-gap][same])
            slots.append(pair[same])
    return np.concatenate(rows), (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int32)


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            row, slot = features(piece.column("text"))
            pairs = np.unique(row.astype(np.int64) << BITS | slot)
            bounds = np.searchsorted(pairs >> BITS, np.arange(piece.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), lists], ["doc_id", "y", "slots"])


def fit(examples: list[tuple[float, np.ndarray]], p: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and bias after `epochs` passes; slots of an example are distinct."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = bias = 0.0
    for _ in range(p.epochs):
        for y, at in examples:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + root) / p.alpha + p.l2))
            margin = float(np.clip(w.sum() + bias, -35, 35))
            g = 1.0 / (1.0 + np.exp(-margin)) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / p.alpha * w
            n[at] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / p.alpha * bias
            bias_n += g * g
            bias = -bias_z / ((p.beta + np.sqrt(bias_n)) / p.alpha)
    w = np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    return w.astype(np.float32), float(bias)


def _trainer(p: Ftrl):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, ys, lists = (batch.column(k) for k in ("doc_id", "y", "slots"))
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
            rows += [(i, y, flat[a:b].copy()) for i, y, a, b in zip(ids.to_pylist(), ys.to_pylist(), bounds[:-1], bounds[1:])]
        rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[1], len(r[2])))
        weights, bias = fit([r[1:] for r in rows], p)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([weights[at].tobytes()], pa.binary()), pa.array([bias])], ["at", "weight", "bias"])

    return train


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 16_384, params: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias."""
    sets = training_rows(docs, labels, label, max_rows).mapInArrow(_feature_sets, "doc_id long, y double, slots array<int>")
    row = sets.repartition(1).mapInArrow(_trainer(params), "at binary, weight binary, bias double").first()
    if row is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(row["at"], np.int32), np.frombuffer(row["weight"], np.float32), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weight
        for batch in batches:
            for piece in pieces(batch):
                row, slot = features(piece.column("text"))
                some = np.flatnonzero(dense[slot])
                pairs = np.unique(row[some].astype(np.int64) << BITS | slot[some])
                total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], piece.num_rows) + bias
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 16_384, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (chance of being toxic), predicted."""
    scored = score(docs, train(docs, labels, "toxic", max_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
