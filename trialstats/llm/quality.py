"""Quality: nearest-neighbour voting among labelled latent-semantic vectors.

Texts become log counts of hashed byte trigrams and of a few structural terms
(words, words that repeat the one before, words met before in the text, lines,
capitals, digits, marks), weighted by inverse document frequency over all
documents (one vector of SLOTS counts from each task).  A
truncated singular value decomposition of at most `max_rows` labelled texts
gives the latent space.  Those labelled vectors are broadcast (max_rows x DIMS
floats) and each document's exact cosine with every one of them is a blocked
matrix product; the NEIGHBOURS nearest vote with weight cosine**POWER, label 0 more by its
rarity among the labelled (at most MOST_RARITY).

Defined cases: null and empty texts, and texts without weight in the latent
space, score the share of label 1; labelled vectors that tie for the last place
among the neighbours are taken in an order that depends on the labelled rows
alone; very long texts count whole, in constant memory; without usable labels every score is 0.5;
repeated rows score alike, one row out for each row in; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from trialstats.llm.labelled import held_out, training_rows
from trialstats.llm.words import hash_words, pieces, words

TRIGRAMS = 2048
SLOTS = TRIGRAMS + 8
DIMS = 48
NEIGHBOURS = 25
POWER = 16
MOST_RARITY = 4.0
BLOCK = 256
SHARE = 1000
EMPHASIS = 3.0
MARK = np.zeros(256, bool)
MARK[list(b"*%$&#!@^~=<>{}")] = True


def counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed byte trigrams and of structural terms, a row of SLOTS for each text."""
    w = words(texts)
    data, offsets = w.data, w.offsets
    rows = len(offsets) - 1
    out = np.zeros((rows, SLOTS), np.float32)
    if not len(w.start):
        return out
    d = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint32)
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)
    for i in range(rows):
        a, b = offsets[i], offsets[i + 1] - 2
        if b > a:
            out[i, :TRIGRAMS] = np.bincount(slot[a:b], minlength=TRIGRAMS)
    text = np.repeat(np.arange(rows), np.diff(offsets))
    h = hash_words(w)
    order = np.lexsort((h, w.row))
    met = (h[order][1:] == h[order][:-1]) & (w.row[order][1:] == w.row[order][:-1])
    again = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    terms = (
        w.row, w.row[1:][again], w.row[order][1:][met], text[data == 10], text[(data >= 65) & (data <= 90)],
        text[(data >= 48) & (data <= 57)], text[MARK[data]], text[data == 124],
    )
    for k, at in enumerate(terms):
        out[:, TRIGRAMS + k] = np.bincount(at, minlength=rows)
    # the first structural term is the text's length; the others count as shares of it
    out[:, TRIGRAMS + 1 :] *= (SHARE / np.maximum(out[:, TRIGRAMS], 1))[:, None]
    out[:, TRIGRAMS] = 0
    return out


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for piece in pieces(batch):
            seen += (counts(piece.column("text")) > 0).sum(0)
            rows += piece.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1, dtype=np.int32)), pa.array(np.r_[seen, rows])], ["slot", "n"])


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    n = np.zeros(SLOTS + 1)
    for slot, count in docs.select("text").mapInArrow(_document_frequency, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        n[slot] = count
    return (np.log((1 + n[-1]) / (1 + n[:-1])) + 1).astype(np.float32)


def weighted(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)) * idf
    x[:, TRIGRAMS:] *= EMPHASIS
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _training_vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                x = weighted(piece.column("text"), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    return run


def products(x: np.ndarray) -> np.ndarray:
    """x.T @ x in single precision."""
    x = x.astype(np.float32, copy=False)
    return x.T @ x


def fit(x: np.ndarray) -> np.ndarray:
    """Right singular vectors of the DIMS largest singular values (SLOTS x DIMS)."""
    _, vectors = np.linalg.eigh(products(x))
    return np.ascontiguousarray(vectors[:, ::-1][:, :DIMS]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6_000):
    """idf, projection, labelled unit vectors, their labels; None without labels.

    The driver holds at most max_rows half-precision rows of SLOTS (24 MB)."""
    idf = inverse_frequency(docs)
    rows = training_rows(docs, labels, label, max_rows).mapInArrow(_training_vectors(idf), "doc_id long, y double, x binary").toArrow()
    if not rows.num_rows:
        return None
    order = np.argsort(rows["doc_id"].to_numpy())  # a row for each id
    y = rows["y"].to_numpy()[order].astype(np.float32)
    x = np.empty((len(order), SLOTS), np.float16)
    for k, at in enumerate(order.tolist()):
        x[k] = np.frombuffer(rows["x"][at].as_buffer(), np.float16)
    del rows  # half precision only while the eigenvectors are made
    projection = fit(x)
    v = x.astype(np.float32) @ projection
    norm = np.linalg.norm(v, axis=1)
    keep = norm > 1e-6
    return idf, projection, (v[keep] / norm[keep, None]).astype(np.float32), y[keep], float(y.mean())


def votes(v: np.ndarray, known: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Share of label 1 among the nearest known vectors, weighted by similarity."""
    norm = np.linalg.norm(v, axis=1)
    out = np.full(len(v), prior)
    k = min(NEIGHBOURS, len(known))
    rarity = min(MOST_RARITY, max(1.0, float((y > 0.5).sum()) / max(1, int((y <= 0.5).sum()))))
    for a in range(0, len(v), BLOCK):
        at = a + np.flatnonzero(norm[a : a + BLOCK] > 1e-6)
        if not len(at) or not k:
            continue
        cosine = (v[at] / norm[at, None]) @ known.T
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER * np.where(y[near] > 0.5, 1.0, rarity)
        total = weight.sum(1)
        out[at] = np.where(total > 0, (weight * y[near]).sum(1) / np.maximum(total, 1e-12), prior)
    return np.clip(out, 0, 1)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            if model is None:
                scores = np.full(piece.num_rows, 0.5)
            else:
                idf, projection, known, y, prior = model
                scores = votes(weighted(piece.column("text"), idf) @ projection, known, y, prior)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores, pa.float64())], [*piece.schema.names, "score"])


def score_rows(docs: DataFrame, model) -> DataFrame:
    """The rows with their score; columns that clash with `score` are replaced."""
    rest = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rest.mapInArrow(lambda batches: _score(batches, sent.value), T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every row."""
    return score_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "score")


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (chance of label 1), predicted."""
    scored = score(docs, train(docs, labels, "quality", max_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
