import hashlib
import random
import re

import xxhash

from tests.llm.conftest import ODD
from trialstats.llm import fingerprints


def simhash(text):
    votes, total = [0] * 64, 0
    for word in re.split(r"[ \t\n\x0b\f\r]+", text):
        if not word:
            continue
        weight = min(max(len(word) - 1, 1), 8)
        h = xxhash.xxh64(word.encode(), seed=42).intdigest()
        total += weight
        for bit in range(64):
            votes[bit] += weight * (h >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > total)


def alike(a, b):
    return 1 - bin(a ^ b).count("1") / 64


def brute(rows):
    """by doc_id, which is distinct"""
    order = sorted(rows, reverse=True)
    out = {}
    every = {i: simhash(t or "") for i, t in rows}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + (following[1] or "")[:cut]
        e = simhash(edited)
        near = sum(bin(every[i] ^ f).count("1") <= 3 for f in every.values()) - 1 if i % 50 == 0 else None
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{every[i]:016x}", f"{e:016x}", alike(every[i], e), alike(every[i], every[following[0]]), near)
    return out


def result(frame):
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]
    return {r["doc_id"]: tuple(r[n] for n in names) for r in fingerprints.edited_fingerprints(frame).collect()}


def test_against_definition(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert result(documents) == brute(rows)


def test_uneven_ids_and_few_rows(make):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("ab cde fghij klmnopq é漢".split()) for _ in range(r.randrange(40)))) for i in {r.randrange(10) ** 9 * r.randrange(50) - 5 for _ in range(300)}]
    assert result(make(rows)) == brute(rows)
    assert result(make([(5, "alone with some words")])) == brute([(5, "alone with some words")])


def test_search_finds_all_within_radius(spark):
    r = random.Random(2)
    values = {r.getrandbits(64) for _ in range(60)}
    values |= {v ^ sum(1 << b for b in r.sample(range(64), k)) for v in list(values) for k in (1, 2, 3, 4)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v, 1) for v in signed], "fp long, copies long")
    for radius, blocks in ((3, 6), (2, 4), (4, 7)):
        got = sorted((x["fp"], x["other"], x["distance"]) for x in fingerprints.within(fps, fps, radius, blocks).collect())
        want = sorted((a, b, d) for a in signed for b in signed if (d := bin((a ^ b) & (1 << 64) - 1).count("1")) <= radius)
        assert got == want


def test_odd_rows(make):
    out = fingerprints.edited_fingerprints(make(ODD)).collect()
    assert len(out) == len(ODD)
    assert {r["fingerprint"] for r in out if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert fingerprints.edited_fingerprints(make([])).collect() == []
    twice = [r for r in out if r["doc_id"] == 7 and r["n_chars"] == 18]
    assert len(twice) == 2 and twice[0]["fingerprint"] == twice[1]["fingerprint"]
