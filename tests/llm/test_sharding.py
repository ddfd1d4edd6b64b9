import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from trialstats.llm import sharding


def laws(rows, total, shards=24):
    """rows are (shard, slot): counts at most one apart, slots without gaps"""
    slots = {}
    for shard, slot in rows:
        slots.setdefault(shard, []).append(slot)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert sum(counts) == total and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))


def test_documents(documents):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in documents.collect())
    got = sharding.report(documents).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    laws([(r["shard"], r["slot"]) for r in got], sum(want.values()))
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_same_draw_however_the_table_is_split(spark, documents):
    kept = None
    for parts, shuffles in ((1, "3"), (7, "11")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        got = Counter(tuple(r) for r in sharding.shuffled(documents.repartition(parts), bucket_bytes=20_000).select("doc_id", "text", "shard", "slot").collect())
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert kept is None or got == kept
        kept = got
    other = Counter(tuple(r) for r in sharding.shuffled(documents, seed=5, bucket_bytes=20_000).select("doc_id", "text", "shard", "slot").collect())
    assert other != kept


def test_odd_and_repeated_rows(make):
    rows = ODD + [(77, "one hot record")] * 700
    got = sharding.shuffled(make(rows), bucket_bytes=2_000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    laws([(r["shard"], r["slot"]) for r in got], len(rows))
    hot = Counter(r["shard"] for r in got if r["doc_id"] == 77)
    assert len(hot) == 24 and max(hot.values()) <= 31
    assert got[0]["bucket"] == "x" and got[0]["node"] == "x"  # clashing names are carried along
    assert sharding.shuffled(make([])).collect() == []


def test_order_is_uniform(spark):
    """Place and id are independent: counts in a table of both pass a chi-square test."""
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = sharding.shuffled(docs, bucket_bytes=17 * 200).select("doc_id", "shard").collect()
    cells = Counter((r["doc_id"] * 24 // n, r["shard"]) for r in got)
    expected = n / 24 / 24
    chi = sum((cells.get((a, b), 0) - expected) ** 2 / expected for a in range(24) for b in range(24))
    assert 23 * 23 - 160 < chi < 23 * 23 + 160  # five standard deviations


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates([0, 1, 2, 3], 1, b)) for b in range(24_000))
    assert len(seen) == 24 and all(840 < v < 1160 for v in seen.values())


def test_written_shards(spark, documents, tmp_path):
    sharding.write(documents, str(tmp_path / "out"), shards=5, bucket_bytes=50_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"]) for r in documents.collect())
    laws([(r["shard"], r["slot"]) for r in back.select("shard", "slot").collect()], documents.count(), 5)
