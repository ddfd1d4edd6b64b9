import random

import numpy as np

from tests.llm.conftest import ODD
from trialstats.llm import decontaminate as d


def test_block_tables_find_all_within_radius():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 200).astype(np.uint64)
    noisy = np.concatenate([fp ^ sum((np.uint64(1) << np.uint64(b) for b in r.choice(64, k, replace=False)), np.uint64(0)) for k in range(6)])
    index = d.Index(8, 1, fp, np.zeros(200, int), np.arange(200), d.block_index(fp))
    a, b = d.near(index, noisy)
    want = {(i, j) for i, x in enumerate(noisy.tolist()) for j, y in enumerate(fp.tolist()) if bin(x ^ y).count("1") <= d.RADIUS}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_fingerprints_of_windows():
    r = np.random.default_rng(2)
    h, weight = r.integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(3), r.integers(1, 9, 40_000)
    asked = [(8, 4), (3, 1), (24, 4)]
    for (size, stride), got in zip(asked, d.fingerprints(h, weight, asked)):
        starts = range(0, len(h) - size + 1, stride)
        assert len(got) == len(starts)
        for k in list(range(0, len(starts), 997)) + [len(starts) - 1]:
            part, w = h[starts[k] : starts[k] + size], weight[starts[k] : starts[k] + size]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(int) * 2 - 1
            assert np.packbits((bits * w[:, None]).sum(0) > 0).view(np.uint64)[0] == got[k]


def brute(texts, items):
    """(document, item) with a similarity of THRESHOLD at some place, ends up to SLACK words off"""
    import pyarrow as pa

    def profile(t):
        w = d.words(pa.array([t]), lower=True)
        return d.hash_words(w), d.term_weights(w.start, w.end)

    out = set()
    known = [(i, *profile(t)) for i, t in items]
    for doc, t in texts:
        h, weight = profile(t)
        every = d.shingles(h, weight)
        for i, hi, wi in known:
            own = d.shingles(hi, wi)
            if not own or (len(hi) >= d.SHINGLE and own.keys().isdisjoint(every)):
                continue  # without a common shingle nothing is similar
            for low in range(0, len(h)):
                if any(d.similarity(own, d.shingles(h[low : low + n], weight[low : low + n])) >= d.THRESHOLD for n in range(max(1, len(hi) - 3), len(hi) + 4)):
                    out.add((doc, i))
                    break
    return out


def test_planted_passages(spark, make):
    r = random.Random(3)
    vocabulary = [f"{c}{k}ing" for c in "abcdefgh" for k in range(200)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(r.randrange(4, 70)))) for k in range(40)]
    texts = []
    for k in range(150):
        own, (_, item) = words(r.randrange(5, 120)), items[k % 40]
        passage = item.split()
        kind = k % 5
        if kind == 1 and len(passage) >= 36:
            passage[r.randrange(len(passage))] = "edited"
        elif kind == 2:
            passage = [w.upper() for w in passage]
        elif kind == 3:
            passage = passage[: len(passage) // 2]
        elif kind == 4:
            passage = []
        at = r.randrange(len(own))
        texts.append((k, " ".join(own[:at] + passage + own[at:])))
    found = {(x["doc_id"], x["item_id"]) for x in d.hits(make(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(texts, items)
    assert found <= want
    planted = {(k, k % 40) for k in range(150) if k % 5 in (0, 2)}
    assert planted <= found
    assert len(found) >= 0.98 * len(want)


def test_slabs_give_the_same(documents, benchmark_items, monkeypatch):
    one = {tuple(r) for r in d.hits(documents, benchmark_items).collect()}
    monkeypatch.setattr(d, "SLAB", 300)
    assert {tuple(r) for r in d.hits(documents, benchmark_items).collect()} == one and one


def test_clean_and_odd_rows(spark, make):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "twice the same row"), (5, "twice the same row")], "item_id long, text string")
    frame = make(ODD)
    found = d.hits(frame, items).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in found) == [(5, 1), (7, 0), (7, 0), (7, 5), (7, 5)]
    kept = d.clean(frame, items)
    assert kept.columns == frame.columns and kept.count() == len(ODD) - 3
    assert d.hits(make([]), items).collect() == [] and d.hits(frame, items.limit(0)).collect() == []


def widest(texts, items):
    """(document, item) -> the best similarity of a passage of any place and length, if it reaches THRESHOLD"""
    import pyarrow as pa

    def profile(t):
        w = d.words(pa.array([t]), lower=True)
        return d.hash_words(w), d.term_weights(w.start, w.end)

    out, known = {}, [(i, *profile(t)) for i, t in items]
    for doc, t in texts:
        h, weight = profile(t)
        every = d.shingles(h, weight)
        for i, hi, wi in known:
            own = d.shingles(hi, wi)
            if own.keys().isdisjoint(every):
                continue
            like = max(d.similarity(own, d.shingles(h[a:b], weight[a:b])) for a in range(len(h)) for b in range(a + 1, len(h) + 1))
            if like >= d.THRESHOLD:
                out[doc, i] = like
    return out


def test_passages_of_other_lengths(spark, make):
    r = random.Random(4)
    vocabulary = [f"{c}{k}" for c in "abcdefgh" for k in range(100, 999)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items, texts = [], []
    for k, (n, inserted, deleted) in enumerate([(50, 0, 4), (60, 0, 6), (60, 6, 0), (90, 12, 0), (90, 0, 14), (50, 4, 0), (60, 20, 0), (60, 0, 18)]):
        item = words(n)
        items.append((k, " ".join(item)))
        passage = item[: n // 2] + words(inserted) + item[n // 2 + deleted :]
        texts.append((k, " ".join(words(15) + passage + words(15))))
    texts.append((100, " ".join([texts[0][1]] * 3)))
    want = widest(texts, items)
    assert {(k, k) for k in range(6)} <= want.keys() and len(want) < 9
    found = d.hits(make(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): x["similarity"] for x in found} == want


def test_best_passage_is_the_best():
    r = np.random.default_rng(5)
    for _ in range(150):
        words = r.integers(0, 1 << 63, 12).astype(np.uint64)
        weights = r.integers(1, 9, 12)
        item, text = (np.minimum(r.integers(0, 12, n), r.integers(2, 12)) for n in (r.integers(1, 14), 30))
        if r.random() < 0.8:
            text[8 : 8 + len(item)] = item
            text = np.delete(text, r.integers(0, 30, r.integers(0, 3)))
        k = min(d.SHINGLE, len(item))
        own = d.shingles(words[item], weights[item])
        value = d.occurrences(words[item], weights[item], k).value
        got, _ = d.best_passage(d.Item(0, k, np.unique(value), sum(own.values())), d.occurrences(words[text], weights[text], k))
        want = max(d.similarity(own, d.shingles(words[text[a:b]], weights[text[a:b]])) for a in range(len(text)) for b in range(a + 1, len(text) + 1))
        assert got == (want if want >= d.THRESHOLD else 0)
