"""Benchmark decontamination: SimHash of item-sized windows, and exact checks of what comes near.

An item of W lower-case words is looked for with windows whose size follows from
W: the longest run of words that every passage with a similarity of THRESHOLD
must share with the item unedited (about half of W), down to the next of SIZES.
All windows of that size in the item are indexed; in the texts a window starts
at every STRIDE-th word (at every word for small sizes), for which the size
leaves room.  Words vote on 64 bits with a weight by their length.

A fingerprint has RADIUS + 1 blocks; fingerprints within RADIUS bits agree in one
of them, so looking up each block finds all.  For a (text, item) with a candidate
the weighted Jaccard similarity of five-word shingles (a shingle's weight is the
sum of its words' weights) is the best of all passages of the text, of any place
and length, and THRESHOLD decides.  Shingles are compared by 64-bit hashes.

Items are broadcast in slabs of at most SLAB words, one pass over the texts for
each slab, so that a large benchmark needs more passes and no more memory.

Defined cases: null and empty texts and items match nothing; an item with fewer
than five words matches as one shingle; repeated rows are reported each; items
with equal texts are all reported; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from trialstats.llm.store import stored
from trialstats.llm.words import first_words, hash_words, pieces, rolled, words

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 3
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24)
STRIDE = 4
SLAB = 1 << 20
BLOCK = 1 << 14


def term_weights(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.clip(end - start - 1, 1, 8)


def window_size(n: int) -> tuple[int, int]:
    """Window size and stride for an item of n words."""
    shingles = max(n - SHINGLE + 1, 1)
    lost = int(shingles * (1 - 2 * THRESHOLD / (1 + THRESHOLD)))
    run = min(n, -(-(shingles - lost) // (lost // SHINGLE + 1)) + SHINGLE - 1)
    if run - STRIDE + 1 >= 8:
        return max(s for s in SIZES if s <= run - STRIDE + 1), STRIDE
    return max(s for s in SIZES if s <= run), 1


def fingerprints(h: np.ndarray, weight: np.ndarray, asked: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each (size, stride) the SimHash of the windows of that size from every stride-th word."""
    n = len(h)
    most = max(size for size, _ in asked)
    out: list[list[np.ndarray]] = [[] for _ in asked]
    for low in range(0, n, BLOCK):  # BLOCK is a multiple of all strides
        high = min(n, low + BLOCK + most - 1)
        bits = np.unpackbits(h[low:high].view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        bits *= 2
        bits -= 1
        bits *= weight[low:high, None].astype(np.int32)
        total = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        for k, (size, stride) in enumerate(asked):
            last = min(low + BLOCK, n - size + 1) - low
            if last > 0:
                votes = total[size : size + last : stride] > total[:last:stride]
                out[k].append(np.packbits(votes, axis=1).view(np.uint64).ravel())
    return [np.concatenate(o) if o else np.zeros(0, np.uint64) for o in out]


class Index(NamedTuple):
    size: int
    stride: int
    fp: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]  # order by a block's value, and where each value begins


def block_index(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    width = 64 // (RADIUS + 1)
    out = []
    for b in range(RADIUS + 1):
        value = (fp >> np.uint64(width * b)) & np.uint64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        out.append((order, np.searchsorted(value[order], np.arange((1 << width) + 1, dtype=np.uint64))))
    return out


def near(index: Index, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (window, indexed window) within RADIUS bits."""
    width = 64 // (RADIUS + 1)
    found = []
    for b, (order, begins) in enumerate(index.blocks):
        value = ((fp >> np.uint64(width * b)) & np.uint64((1 << width) - 1)).astype(np.int64)
        count = begins[value + 1] - begins[value]
        some = np.flatnonzero(count)
        many = count[some]
        query = np.repeat(some, many)
        nth = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
        other = order[begins[value[query]] + nth]
        close = np.bitwise_count(fp[query] ^ index.fp[other]) <= RADIUS
        found.append(query[close] * len(index.fp) + other[close])
    pairs = np.unique(np.concatenate(found))
    return pairs // max(len(index.fp), 1), pairs % max(len(index.fp), 1)


class Item(NamedTuple):
    item_id: int
    k: int  # words of a shingle
    own: np.ndarray  # distinct shingles
    total: int  # and their weight


def shingles(h: np.ndarray, weight: np.ndarray) -> dict[tuple, int]:
    """Weight of every distinct shingle."""
    words_, weights, k = h.tolist(), weight.tolist(), min(SHINGLE, len(h))
    return {tuple(words_[i : i + k]): sum(weights[i : i + k]) for i in range(len(words_) - k + 1)} if k else {}


def similarity(a: dict[tuple, int], b: dict[tuple, int]) -> float:
    both = sum(w for s, w in a.items() if s in b)
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


class Places(NamedTuple):
    """The shingles of a text, by place."""

    weight: np.ndarray
    before: np.ndarray  # the place before with the same shingle, or -1
    after: np.ndarray  # the next such place, or their number
    value: np.ndarray  # all in order
    order: np.ndarray  # and their places


def occurrences(h: np.ndarray, weight: np.ndarray, k: int) -> Places:
    value = rolled(h, k)
    n = len(value)
    total = np.concatenate([[0], np.cumsum(weight)])
    order = np.argsort(value, kind="stable")
    value = value[order]
    same = value[1:] == value[:-1]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return Places(total[k:] - total[:-k] if n else np.zeros(0, np.int64), before, after, value, order)


def read_items(rows: list) -> tuple[list[Item], list[Index]]:
    """Items, and an index for each window size."""
    texts = pa.array([r["text"] for r in rows], pa.string())
    w = words(texts, lower=True)
    h, weight, at = hash_words(w), term_weights(w.start, w.end), first_words(w)
    items, by_size = [], {}
    for k, r in enumerate(rows):
        a, b = int(at[k]), int(at[k + 1])
        if a == b:
            continue
        places = occurrences(h[a:b], weight[a:b], min(SHINGLE, b - a))
        first = places.before < 0
        items.append(Item(r["item_id"], min(SHINGLE, b - a), places.value[first[places.order]], int(places.weight[first].sum())))
        size, stride = window_size(b - a)
        fp = fingerprints(h[a:b], weight[a:b], [(size, 1)])[0]
        by_size.setdefault((size, stride), []).append((fp, np.full(len(fp), len(items) - 1), np.arange(len(fp))))
    indexes = []
    for (size, stride), found in sorted(by_size.items()):
        fp, item, offset = (np.concatenate([f[k] for f in found]) for k in range(3))
        indexes.append(Index(size, stride, fp, item, offset, block_index(fp)))
    return items, indexes


def best_passage(item: Item, text: Places) -> tuple[float, int]:
    """The best similarity of the item with a passage of the text, and where that starts; (0, 0) below THRESHOLD.

    A best passage begins with a shingle of the item that it does not repeat (else
    it is as good without it), and has no more foreign weight than THRESHOLD leaves."""
    n = len(text.weight)
    low, high = np.searchsorted(text.value, item.own, "left"), np.searchsorted(text.value, item.own, "right")
    mine = np.zeros(n, bool)
    mine[text.order[np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())]] = True
    held = np.concatenate([[0], np.cumsum(np.where(mine, text.weight, 0))])
    starts = np.flatnonzero(mine)
    most = held[text.after[starts]] - held[starts]
    spare = item.total * (1 / THRESHOLD - 1)
    best, at = 0.0, 0
    for start, bound in zip(starts.tolist(), most.tolist()):
        if bound < THRESHOLD * item.total or bound <= best * item.total:
            continue
        end, size = int(text.after[start]), 2 * len(item.own) + 8
        while True:
            span = slice(start, min(end, start + size))
            new = np.where(text.before[span] < start, text.weight[span], 0)
            every = np.cumsum(new)
            both = np.cumsum(np.where(mine[span], new, 0))
            if span.stop == end or every[-1] - both[-1] > spare:
                break
            size *= 2
        like = float((both / (item.total + every - both)).max())
        if like > best:
            best, at = like, start
        if best == 1:
            break
    return (best, at) if best >= THRESHOLD else (0.0, 0)


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, indexes = [Item(*i) for i in sent.value[0]], [Index(*i) for i in sent.value[1]]
        asked = [(i.size, i.stride) for i in indexes]
        for batch in batches:
            for piece in pieces(batch):
                w = words(piece.column("text"), lower=True)
                if not asked or not len(w.start):
                    continue
                h, weight, at = hash_words(w), term_weights(w.start, w.end), first_words(w)
                found = []
                for index, fp in zip(indexes, fingerprints(h, weight, asked)):
                    if not len(fp):
                        continue
                    window, other = near(index, fp)
                    begin = window * index.stride
                    row = w.row[begin]
                    whole = w.row[begin + index.size - 1] == row
                    found.append(np.unique(row[whole] * len(items) + index.item[other[whole]]))
                hits, here, texts = [], -1, {}
                for pair in np.unique(np.concatenate(found)).tolist() if found else []:
                    row, item = pair // len(items), items[pair % len(items)]
                    if row != here:
                        here, texts = row, {}
                    if item.k not in texts:
                        texts[item.k] = occurrences(h[at[row] : at[row + 1]], weight[at[row] : at[row + 1]], item.k)
                    like, begin = best_passage(item, texts[item.k])
                    if like:
                        hits.append((row, item.item_id, like, begin))
                rows = pa.array([x[0] for x in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(rows), pa.array([x[1] for x in hits], pa.int64()), pa.array([x[2] for x in hits], pa.float64()), pa.array([x[3] for x in hits], pa.int64()), piece.column("key").take(rows)],
                    ["doc_id", "item_id", "similarity", "start_word", "key"],
                )

    return run


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word (of the best passage), key (hash of doc_id and text)."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("key", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    slabs = -(-size // SLAB) or 1
    found = None
    for k in range(slabs):  # at most about SLAB words of items at a time
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slabs)) == k).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        known, indexes = read_items(rows)
        sent = spark.sparkContext.broadcast(([tuple(i) for i in known], [tuple(i) for i in indexes]))
        part = plain.mapInArrow(_scan(sent), "doc_id long, item_id long, similarity double, start_word long, key long")
        found = part if found is None else found.unionAll(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage."""
    keys = stored(hits(docs, benchmark).select("key").distinct(), "contaminated").withColumnRenamed("key", "__key")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("__key", key).join(keys, "__key", "left_anti").select(*docs.columns)
