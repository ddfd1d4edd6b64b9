"""Words of whole Arrow text columns as numpy arrays, with 64-bit hashes.

A word is a maximal run of bytes other than blank and 09-0D; UTF-8 never uses
those bytes inside a character.  Work goes in pieces of about a megabyte of
text, so that memory does not follow the size of Spark's batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after the other
    offsets: np.ndarray  # first byte of each text, and the end
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    row: np.ndarray  # text of each word


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text; a longer text is a slice of its own."""
    size = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        to = min(to, at + 50_000)
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    texts = pa.compute.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] |= inside[edge]
    last[edge[1:] - 1] |= inside[edge[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, start, end, np.searchsorted(offsets, start, "right") - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, eight bytes at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    size = end - start
    h = mix((size.astype(np.uint64) + np.uint64(seed)) * _ODD)
    left, at, which = size, start, None
    while True:
        chunk = eight[at] & _MASK[np.minimum(left, 8)]
        if which is None:
            h = mix((h ^ chunk) + _ODD)
        else:
            h[which] = mix((h[which] ^ chunk) + _ODD)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        which = more if which is None else which[more]
        left, at = left[more] - 8, at[more] + 8


def hash_words(w: Words, seed: int = 0) -> np.ndarray:
    return hashed(w.data, w.start, w.end, seed)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _ODD
        out += h[j : j + n]
    return mix(out)


def first_words(w: Words) -> np.ndarray:
    """Index of the first word of each text, and the number of words at the end."""
    return np.searchsorted(w.row, np.arange(len(w.offsets)), "left")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrays(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values[bounds[i]:bounds[i + 1]] as the i-th list."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
