"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then Fisher-Yates in each.

First pass: every record goes to a bucket drawn uniformly by a seeded hash of its
content; there are as many buckets as records of BUCKET_BYTES each need, so one
fits into a task's memory at any size of the table.  Second pass: the records of
a bucket are put in the order of their hashes, shuffled by Fisher-Yates with a
generator seeded by seed and bucket, and written.  Read bucket after bucket the
table is then in uniformly random order.  The shards are equal stretches of that
order, so their counts differ by one at most (the law `rows`); the first place
of a bucket is the sum of the counts before it, known from a pass over hashes
alone, so shard and slot are written with the record.

The draw depends on content, seed and the number of buckets only, not on how the
table was split or which task was repeated.  Rows that agree in every column
would all be drawn into one bucket; they are counted first and their copies
numbered, and the number is hashed as well, so that a record that makes up a
third of the table is spread like any other.  Equal texts under different ids are
different records; no law keeps them together.

Defined cases: a null text counts no bytes, its CRC is that of the empty text;
null and repeated doc_ids are records like any other; a record longer than
BUCKET_BYTES is whole in its bucket; equal hashes (128 bits) count as equal rows;
an empty table gives no rows and no files; extra columns are carried along, and
those named like the results are replaced.  Columns must be hashable (no maps).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialstats.llm.store import partitions, stored

SHARDS = 24
SEED = 20_240_607
BUCKET_BYTES = 16 << 20
#: what a record takes besides its text
RECORD_BYTES = 8
RESULTS = ("size", "shard", "slot")
# buckets whose counts are added up by one task
STRETCH = 4096


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def _identified(docs: DataFrame, column: str) -> DataFrame:
    """Every row as one value r, so that no column's name can clash, its size, and two hashes of all of it."""
    every = [docs[c] for c in docs.columns]
    return docs.select(F.struct(*every).alias("r"), size_of(docs[column]).alias("size"), F.xxhash64(*every).alias("h"), F.xxhash64(*every, F.lit(1)).alias("k"))


def _bucket(seed: int, buckets: int) -> Column:
    """Drawn for each record (h, k, number)."""
    return F.pmod(F.xxhash64("h", "k", "number", F.lit(seed)), F.lit(buckets)).cast("long").alias("bucket")


def _bases(counts: DataFrame) -> DataFrame:
    """bucket, base: the records in all buckets before it, added up in two steps so that no task holds all buckets."""
    stretch = F.floor(F.col("bucket") / STRETCH).alias("stretch")
    inner = Window.partitionBy("stretch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.select("bucket", stretch, "n").withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    outer = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(stretch).agg(F.sum("n").alias("n"))
    sums = sums.select("stretch", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("ahead"))
    return local.join(sums, "stretch").select("bucket", (F.col("ahead") + F.col("inside")).alias("base"))


def fisher_yates(order: list[int], seed: int, bucket: int) -> list[int]:
    """The list in place, every order equally likely; seed and bucket decide which."""
    draws = np.random.Generator(np.random.Philox(key=[seed, bucket])).integers(0, np.arange(len(order), 1, -1), dtype=np.int64)
    for k, j in zip(range(len(order) - 1, 0, -1), draws.tolist()):
        order[k], order[j] = order[j], order[k]
    return order


def _mixed(seed: int, shards: int, rows: int):
    """Rows that come bucket by bucket, the bucket's base first: the records shuffled, with their shard and slot."""
    bounds = np.array([s * rows // shards for s in range(shards + 1)], np.int64)

    def done(number: int, base: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = pa.Table.from_batches(held).combine_chunks()
        known = np.lexsort([records.column(c).to_numpy() for c in ("number", "k", "h")])
        order = np.array(fisher_yates(known.tolist(), seed, number), np.int64)
        at = base + np.arange(len(order))
        shard = np.searchsorted(bounds, at, "right") - 1
        out = pa.table([records.column("r").take(pa.array(order)), pa.array(shard.astype(np.int32)), pa.array(at - bounds[shard])], ["r", "shard", "slot"])
        yield from out.to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base, held = -1, 0, []
        for batch in batches:
            if not len(batch):
                continue
            of = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if of[a] != number:
                    if held:
                        yield from done(number, base, held)
                    number, base, held = int(of[a]), batch.column("base")[a].as_py(), []
                    a += 1
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from done(number, base, held)

    return run


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, column: str = "text") -> DataFrame:
    """The table in shards: size (bytes), shard (0 to shards - 1), slot (place in the shard, from 0)."""
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    known = _identified(docs, column)
    row = known.schema["r"].dataType.simpleString()
    hashes = stored(known.select("h", "k", "size"), "hashes")
    rows, total = hashes.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    # rows that agree in every column, as one row and the number of its copies
    repeated = stored(hashes.groupBy("h", "k").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated")
    single = F.lit(0).cast("long").alias("number")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("number")
    if repeated.isEmpty():
        drawn, records = hashes.select("h", "k", single), known.select("r", "h", "k", single)
    else:
        drawn = hashes.join(repeated, ["h", "k"], "left_anti").select("h", "k", single).unionByName(repeated.select("h", "k", copies))
        one_each = known.join(repeated, ["h", "k"], "left_semi").groupBy("h", "k").agg(F.first("r").alias("r"))
        records = known.join(repeated, ["h", "k"], "left_anti").select("r", "h", "k", single)
        records = records.unionByName(one_each.join(repeated, ["h", "k"]).select("r", "h", "k", copies))
    counts = drawn.select(_bucket(seed, buckets)).groupBy("bucket").agg(F.count("*").alias("n"))
    heads = _bases(counts).select("bucket", "base")
    records = records.select("r", "h", "k", "number", _bucket(seed, buckets))
    dealt = records.unionByName(heads, allowMissingColumns=True).repartition(partitions(spark), "bucket")
    dealt = dealt.sortWithinPartitions("bucket", F.col("base").isNull())
    moved = dealt.mapInArrow(_mixed(seed, shards, rows), f"r {row}, shard int, slot long")
    return moved.select("r.*", size_of(F.col("r").getField(column)).alias("size"), "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, column: str = "text") -> None:
    """The shards as Parquet, a folder for each, the records of every file in the order of their slots."""
    found = shuffled(docs, shards, seed, bucket_bytes, column)
    found.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record."""
    found = shuffled(docs)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
