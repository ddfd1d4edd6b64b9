"""Many small rows of integers moved as blocks: a row of Spark's for each bucket and stretch of a task.

Rows of blocks are written, shuffled and sorted much faster than those in them.  The task that
reads a bucket has all its rows at once, so buckets should be many."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialstats.llm.store import partitions

# rows that a task puts into blocks at a time, and buckets for each partition
HELD = 1 << 19
BUCKETS = 4
SCHEMA = "bucket int, data binary"


def buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit hash by its upper half, from 0 to n - 1."""
    return (hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def _block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    bucket, rows = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    offsets = np.r_[start, len(rows)].astype(np.int32) * np.int32(8 * rows.shape[1])
    data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), data], ["bucket", "data"])


def packed(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(bucket, data) of pairs of buckets and rows (int64, a line for each row); a bucket's rows are of one width."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    size: dict[int, int] = defaultdict(int)
    for bucket, rows in pairs:
        width = rows.shape[1]
        held[width].append((bucket, rows))
        size[width] += len(rows)
        if size[width] >= HELD:
            yield _block(held.pop(width))
            size[width] = 0
    yield from (_block(held[width]) for width in held if size[width])


def dealt(blocks: DataFrame) -> DataFrame:
    """Blocks with all of a bucket in one partition, one after the other."""
    return blocks.repartition(partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket")


def whole(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The rows of one bucket after the other, of blocks sorted by bucket."""
    for _, values in filled(batches):
        yield values.reshape(-1, width)


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """One bucket after the other, of blocks sorted by bucket, and the values of all its rows."""
    held, last = [], None
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
            if bucket != last and held:
                yield last, np.concatenate(held)
                held = []
            last = bucket
            held.append(np.frombuffer(data.as_buffer(), np.int64))
    if held:
        yield last, np.concatenate(held)
