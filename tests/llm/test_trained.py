import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from trialstats.llm import quality, toxicity

LARGER = "/root/testdata/sf0.1"


def score_of(spark, frame, label):
    known = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = frame.join(known, "doc_id").where("held_out").select("doc_id", label, "score", "predicted").collect()
    assert len(rows) > 300
    pairs = sorted((r["score"], r[label]) for r in rows)
    ones = sum(y for _, y in pairs)
    below = rank = 0
    for _, y in pairs:
        rank += below * y
        below += 1 - y
    return rank / (ones * (len(pairs) - ones)), sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    auc, right = score_of(spark, quality.quality(docs, labels), "quality")
    assert auc > 0.98 and right > 0.97


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    auc, right = score_of(spark, toxicity.toxicity(docs, labels), "toxic")
    assert auc > 0.88 and right > 0.9


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_rows(make, labels, documents, run):
    out = run(documents, labels).collect()
    assert len(out) == documents.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    odd = run(make(ODD), labels).collect()
    assert len(odd) == len(ODD)
    empty = {round(r["score"], 12) for r in odd if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    assert run(make([]), labels).collect() == []
    without = run(documents, labels.limit(0)).collect()
    assert {r["score"] for r in without} == {0.5}


@pytest.mark.parametrize("run, label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_held_out_labels_are_not_used(documents, labels, run, label):
    from pyspark.sql import functions as F
    from trialstats.llm.labelled import held_out

    turned = labels.withColumn(label, F.when(held_out(), 1 - F.col(label)).otherwise(F.col(label)))
    a = {r["doc_id"]: r["score"] for r in run(documents, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in run(documents, turned).collect()}
    assert a == b


def plain_score(cosines, y, prior):
    """The vote of the nearest, counted out."""
    ones = sum(1 for v in y if v > 0.5)
    rarity = min(quality.MOST_RARITY, max(1.0, ones / max(1, len(y) - ones)))
    nearest = sorted(range(len(y)), key=lambda i: -cosines[i])[: quality.NEIGHBOURS]
    weight = [max(cosines[i], 0.0) ** quality.POWER * (1.0 if y[i] > 0.5 else rarity) for i in nearest]
    return sum(w * y[i] for w, i in zip(weight, nearest)) / sum(weight) if sum(weight) > 0 else prior


def test_quality_votes_against_brute_force(documents, labels):
    """Every document with every labelled vector, in plain loops; equal texts may tie at the last place."""
    idf, projection, known, y, prior = quality.train(documents, labels)
    got = {r["doc_id"]: r["score"] for r in quality.quality(documents, labels).collect()}
    n = documents.count()
    seen = np.zeros(quality.TRIGRAMS, int)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for t in texts.values():
        raw = t.encode()
        slots = {((int.from_bytes(raw[i : i + 3], "big") * 0x9E3779B1) % 2**32) >> 21 for i in range(len(raw) - 2)}
        seen[list(slots)] += 1
    assert np.allclose(idf[: quality.TRIGRAMS], np.log((1 + n) / (1 + seen)) + 1, rtol=1e-5)
    checked = 0
    for i, t in list(texts.items())[:300]:
        v = (quality.weighted(pa.array([t]), idf) @ projection)[0].astype(float)
        if not np.linalg.norm(v) > 1e-6:
            continue
        cosines = (known.astype(float) @ v / np.linalg.norm(v)).tolist()
        ranked = sorted(cosines, reverse=True)
        if len(ranked) > quality.NEIGHBOURS and ranked[quality.NEIGHBOURS - 1] - ranked[quality.NEIGHBOURS] < 1e-5:
            continue
        checked += 1
        assert math.isclose(got[i], plain_score(cosines, y.tolist(), prior), abs_tol=1e-4)
    assert checked > 150


def plain_features(text):
    """The words, stems, pairs and skip pairs of a text, repeats included; each kind is apart from the others."""
    words = [re.sub(r"^[.,;:!?\"'()\[\]]{1,3}(?=.)|(?<=.)[.,;:!?\"'()\[\]]{1,3}$", "", w) for w in text.lower().split()]
    stems = [(k, w[:k]) for k in toxicity.STEMS for w in words if len(w) > k]
    return [("word", w) for w in words] + stems + [("pair", *p) for p in zip(words, words[1:])] + [("skip", *p) for p in zip(words, words[2:])]


def test_toxicity_features_and_ftrl_against_brute_force():
    texts = ["one two three four", "Mixed, CASE words! (here) again again", "single", "", "longerword anotherlong one two"]
    row, slot = toxicity.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert (row == k).sum() == len(plain_features(t))
        assert len(set(slot[row == k])) == len(set(plain_features(t)))
    p = toxicity.Ftrl(alpha=0.5, l1=0.3, epochs=4)
    rng = np.random.default_rng(8)
    examples = [(float(rng.random() < 0.4), rng.choice(60, rng.integers(1, 9), replace=False).astype(np.int32)) for _ in range(120)]
    z, n, bias_z, bias_n = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= p.l1 else (math.copysign(p.l1, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)
    bias = lambda: -bias_z / ((p.beta + math.sqrt(bias_n)) / p.alpha)
    for _ in range(p.epochs):
        for y, at in examples:
            w, b = {i: weight(i) for i in at.tolist()}, bias()
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in w:
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / p.alpha * b
            bias_n += g * g
    weights, got = toxicity.fit(examples, p)
    assert np.allclose(weights[:60], [weight(i) for i in range(60)], rtol=1e-5, atol=1e-7) and math.isclose(got, bias(), rel_tol=1e-9)
    assert (weights[:60] == 0).any() and (weights[:60] != 0).any()


def test_one_id_on_many_rows_counts_once(spark, labels):
    """What a model is made from is bounded by ids also where a third of all rows share one."""
    from trialstats.llm.labelled import training_rows

    docs = spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id") - 998).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    marks = spark.range(1, 2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    rows = training_rows(docs, marks.union(marks), "toxic", 500).collect()
    assert len(rows) == 500 and len({r["doc_id"] for r in rows}) == 500
    every = {r["doc_id"]: r["text"] for r in training_rows(docs, marks, "toxic", 10_000).collect()}
    assert every[1] == "t0" and zlib.crc32(b"1") % 5 != 0
