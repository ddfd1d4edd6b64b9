"""Document fingerprints: 64-bit SimHash, and the search of all fingerprints within a Hamming radius.

DataFrame operations only.  A text's terms are its words; each occurrence votes
with a weight by the word's length (2 characters or fewer: 1, up to 8) for or
against every bit of the word's hash, and a bit is set if more weight is for it
than against.  Votes of two bits share one sum (32 bits each), so 32 sums carry
64 bits through the aggregation.

Search: a fingerprint has BLOCKS blocks.  Two fingerprints within `radius`
differ in at most `radius` blocks, so they agree on all others; for every choice
of BLOCKS - radius blocks there is one (permuted) table keyed by those blocks,
and an equal key in some table is certain.  The Hamming distance is then checked
and a pair is reported from the first table that shows it only.

Defined cases: null and empty texts have fingerprint 0; equal texts have equal
fingerprints; repeated rows give a row each; rows with equal doc_id are ordered
by the text's SHA-256; a null doc_id sorts as the smallest; the only document is
its own next one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialstats.llm.store import partitions, stored

BREAK = r"[ \t\n\x0B\f\r]+"
BLOCKS = 6
LANES = 0x0000000100000001


def _edges(n: int) -> list[int]:
    return [64 * k // n for k in range(n + 1)]


def ranged(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the range of doc_id they fall in, and (doc_id, to): the largest id of
    each range and the next higher range with rows (of the largest of all: the lowest)."""
    cuts = docs.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    tops = F.array(*[F.lit(c) for c in cuts[::step]]).cast("array<bigint>")
    group = F.size(F.filter(tops, lambda c: c < F.col("doc_id")))  # cuts[::step] below the id
    # cuts below the id: all before the last such top, and some of the step after it
    parts = F.array(*[F.array(*[F.lit(c) for c in cuts[k : k + step]]).cast("array<bigint>") for k in range(0, len(cuts), step)])
    inside = F.size(F.filter(F.get(parts, group - 1), lambda c: c < F.col("doc_id")))
    number = F.when(F.col("doc_id").isNull() | (group == 0), 0).otherwise((group - 1) * step + inside) if cuts else F.lit(0)
    placed = docs.withColumn("bucket", number.cast("int"))
    # at most `buckets` rows
    top = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.max(F.coalesce("doc_id", F.lit(-(1 << 63))))).collect())
    to = [(top[k][1], top[(k + 1) % len(top)][0]) for k in range(len(top))]
    return placed, docs.sparkSession.createDataFrame(to, "top long, to int")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, doc_id, text, sha and, of the next document in descending order of doc_id, next_text and next_sha."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed, tops = ranged(plain, 4 * partitions(docs.sparkSession))
    low = F.lit(-(1 << 63))
    lowest = F.lit(0)
    # a range's largest rows also follow, as guests, the smallest of the next higher range
    guests = placed.join(F.broadcast(tops), F.coalesce("doc_id", low) == F.col("top"))
    wraps = F.col("to") <= F.col("bucket")
    rows = placed.select("bucket", "doc_id", "text", lowest.alias("guest")).unionAll(
        guests.select(F.col("to").alias("bucket"), "doc_id", "text", F.when(wraps, 2).otherwise(1).alias("guest"))
    ).withColumn("sha", F.sha2("text", 256))
    order = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("sha").desc())
    return (
        rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sha", F.lead("sha").over(order))
        .where("guest = 0").drop("guest")
    )


def votes(h: Column, weight: Column) -> list[Column]:
    """32 sums; the j-th counts bit j in its lower half and bit j + 32 in its upper half."""
    lane = lambda j: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES))
    return [F.sum(lane(j) * weight).alias(f"v{j}") for j in range(32)] + [F.sum(weight).alias("total")]


def decided() -> Column:
    """The fingerprint from the sums of votes()."""
    low = [(j, F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF))) for j in range(32)]
    high = [(j + 32, F.shiftrightunsigned(F.col(f"v{j}"), 32)) for j in range(32)]
    bits = [F.when(count * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")) for bit, count in low + high]
    while len(bits) > 1:  # balanced, so that the expression stays shallow
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def weighted_terms(text: str, keep: list[str]) -> list[Column]:
    return [*keep, F.posexplode(F.split(text, BREAK)).alias("at", "word")]


def simhash(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, copies (rows with these keys) and fp, the SimHash of their text; rows with equal keys have equal texts."""
    weight = F.when(F.col("word") == "", 0).otherwise(F.least(F.greatest(F.length("word") - 1, F.lit(1)), F.lit(8))).cast("long")
    terms = rows.select(*weighted_terms(text, keys)).select(*keys, "at", F.xxhash64("word").alias("h"), weight.alias("w"))
    first = F.sum(F.when(F.col("at") == 0, 1).otherwise(0))
    return terms.groupBy(*keys).agg(first.alias("copies"), *votes(F.col("h"), F.col("w"))).select(*keys, "copies", decided().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def text_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _keyed(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """A row for each fingerprint and choice of blocks: the table's number and the kept bits."""
    edges = _edges(blocks)
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        m = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in kept)
        masks.append(m - (1 << 64) if m >> 63 else m)
    every = F.array(*[F.lit(m) for m in masks])
    return fps.select("*", F.posexplode(every).alias("choice", "mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def within(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """(fp, other, distance, copies) for every query fingerprint and every fingerprint within the radius.

    Both sides have distinct `fp`; `fps` carries `copies`."""
    a = _keyed(queries.select("fp"), radius, blocks)
    b = _keyed(fps.select("fp", "copies"), radius, blocks).select(F.col("fp").alias("other"), "copies", F.col("choice").alias("c2"), F.col("key").alias("k2"))
    apart = F.col("fp").bitwiseXOR(F.col("other"))
    edges = _edges(blocks)
    differs = [F.when(apart.bitwiseAND(F.lit(_mask(edges[k], edges[k + 1]))) != 0, 1).otherwise(0) for k in range(blocks)]
    # the first table that shows the pair keeps its first blocks that agree
    seen = F.lit(0)
    before = F.lit(0)
    for k in range(blocks):
        agree = F.lit(1) - differs[k]
        seen = seen.bitwiseOR(F.when((agree == 1) & (before < blocks - radius), F.lit(_mask(edges[k], edges[k + 1]))).otherwise(F.lit(0)).cast("long"))
        before = before + agree
    pairs = a.join(b, (F.col("choice") == F.col("c2")) & (F.col("key") == F.col("k2")) & (F.bit_count(apart) <= radius) & (F.col("mask") == seen))
    return pairs.select("fp", "other", F.bit_count(apart).alias("distance"), "copies")


def _mask(low: int, high: int) -> int:
    m = ((1 << (high - low)) - 1) << low
    return m - (1 << 64) if m >> 63 else m


def edited_fingerprints(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, how alike they are, how
    alike the next document's is; for ids divisible by `every` (and null for others) the number of
    other documents with a fingerprint within `radius`."""
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    both = rows.select(
        "bucket", "doc_id", "n_chars", F.unhex("sha").alias("sha"), F.unhex("next_sha").alias("next_sha"), F.unhex("edited_sha256").alias("edited_sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"),
    ).select("*", "v.kind", "v.text").drop("v")
    keys = ["bucket", "doc_id", "n_chars", "sha", "next_sha", "edited_sha"]
    side = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    made = simhash(both, [*keys, "kind"]).groupBy(*keys).agg(side(0, "copies").alias("copies"), side(0, "fp").alias("fp"), side(1, "fp").alias("edited_fp"))
    made = stored(made.drop("bucket"), "fingerprints")
    texts = stored(made.groupBy("sha").agg(F.max("fp").alias("next_fp")), "texts")
    distinct = stored(made.groupBy("fp").agg(F.sum("copies").alias("copies")), "distinct")
    asked = made.where(F.col("doc_id") % every == 0).select("fp").distinct()
    near = stored(within(asked, distinct, radius).groupBy("fp").agg((F.sum("copies") - 1).alias("n_near")), "near")
    queried = F.col("doc_id") % every == 0
    wide = (
        made.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .join(texts.withColumnRenamed("sha", "next_sha"), "next_sha")
        .join(near.withColumnRenamed("fp", "asked"), queried & (F.col("fp") == F.col("asked")), "left")
    )
    return wide.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), text_of(F.col("fp")).alias("fingerprint"),
        text_of(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )
