"""Packing: length buckets with least padding, and batches of a token budget inside each bucket.

Texts are counted in words (`count` is any long column, so a tokenizer's count
may be given); a longer text than `longest` is cut into sequences of `longest`
words and a rest.  The histogram of all lengths (at most longest + 1 rows)
reaches the driver, where dynamic programming finds the `buckets` upper bounds
with the least total padding.  A batch holds `budget // bound` sequences of one
bucket.  Sequences are numbered in the order of a hash: its leading bits cut
each bucket into RANGES parts, whose sizes give every part its first number, so
a bucket with any share of all rows is still numbered by many tasks and every
batch but a bucket's last is full.

Defined cases: null and empty texts are one sequence of length 0, in the first
bucket; repeated rows are packed like any others; a null doc_id stays; fewer
distinct lengths than buckets give a bucket each, without padding; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialstats.llm.store import stored

RANGE_BITS = 10
WORD = r"[^ \t\n\x0B\f\r]+"


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most `buckets` groups of adjacent lengths with the least padding."""
    order = np.argsort(lengths)
    v, c = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    m = len(v)
    if m <= buckets:
        return v.astype(np.int64)
    rows, tokens = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * v)]
    # padding[i, j]: lengths i..j in one bucket
    padding = v[None, :] * (rows[1:][None, :] - rows[:-1][:, None]) - (tokens[1:][None, :] - tokens[:-1][:, None])
    padding[np.tril_indices(m, -1)] = np.inf
    best, cut = padding[0].copy(), []
    for _ in range(buckets - 1):
        total = np.r_[0, best[:-1]][:, None] + padding
        cut.append(total.argmin(0))
        best = total[cut[-1], np.arange(m)]
    ends, j = [m - 1], m - 1
    for step in reversed(cut):
        j = int(step[j]) - 1
        if j < 0:
            break
        ends.append(j)
    return np.unique(v[ends]).astype(np.int64)


def sequences(docs: DataFrame, longest: int, count: Column | None = None) -> DataFrame:
    """(doc_id, chunk, n_tokens, h): a row for each sequence of each document."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)) if count is None else count, F.lit(0)).cast("long")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), n.alias("n"))
    cut = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0).cast("long")))))
    size = F.least(F.lit(longest).cast("long"), F.col("n") - F.col("chunk") * longest)
    return cut.select("doc_id", "chunk", size.alias("n_tokens"), F.xxhash64("doc_id", "chunk", "t").alias("h"))


def pack(docs: DataFrame, buckets: int = 16, longest: int = 2048, budget: int = 65_536, count: Column | None = None) -> DataFrame:
    """doc_id, chunk, n_tokens, bucket, bound, padding, batch (within the bucket), place (within the batch)."""
    spark = docs.sparkSession
    rows = stored(sequences(docs, longest, count), "packing")
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("rows")).collect()
    ends = bounds(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), buckets)
    ends = np.maximum(ends, 0)
    of = spark.createDataFrame(
        [(int(n), int(np.searchsorted(ends, n)), int(ends[np.searchsorted(ends, n)])) for n, _ in histogram],
        "n_tokens long, bucket int, bound long",
    )
    placed = rows.join(F.broadcast(of), "n_tokens").withColumn("part", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    first = sizes.select("bucket", "part", F.coalesce(before, F.lit(0)).alias("first"))
    number = F.row_number().over(W.partitionBy("bucket", "part").orderBy(F.shiftleft("h", RANGE_BITS), "doc_id", "chunk"))
    # first: at most buckets x 2**RANGE_BITS rows
    numbered = placed.withColumn("k", number - 1).join(F.broadcast(first), ["bucket", "part"]).withColumn("k", F.col("k") + F.col("first"))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest("bound", F.lit(1))), F.lit(1))
    return numbered.select(
        "doc_id", "chunk", "n_tokens", "bucket", "bound", (F.col("bound") - F.col("n_tokens")).alias("padding"),
        F.floor(F.col("k") / room).cast("long").alias("batch"), (F.col("k") % room).cast("long").alias("place"),
    )
