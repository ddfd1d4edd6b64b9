import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ODD
from trialstats.llm import runs


def split(text):
    return re.findall(r"[^ \t\n\x0b\f\r]+", text or "")


def made_periodic(doc_id, words):
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute(words, least=24, times=3):
    """All runs by definition: for each period, the longest stretches in which words that far apart agree."""
    n = len(words)
    code = {}
    x = np.array([code.setdefault(w, len(code)) for w in words], int)
    found = {}
    for q in range(1, n // times + 1):
        same = np.r_[False, x[:-q] == x[q:], False]
        for a, b in zip(np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])):
            if b - a + q >= max(least, times * q):
                found.setdefault((int(a), int(b) + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def expected(doc_id, text, least=24, times=3):
    words = made_periodic(doc_id, split(text))
    found = brute(words, least, times)
    gone = {k for a, length, q in found for k in range(a + q, a + length)}
    best = (None,) * 4
    for a, length, q in found:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (a, length, q, 1000 * length // q)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *best, sha("".join(f"{a},{length},{q}\n" for a, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def rows_of(frame):
    return sorted(((r[0], tuple(r[1:])) for r in frame.collect()), key=repr)


def test_against_definition(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = rows_of(runs.report(documents))
    assert got == sorted(((i, expected(i, t)) for i, t in rows), key=repr)
    assert sum(v[0] > 0 for _, v in got) >= 10


def test_odd_rows(make):
    got = rows_of(runs.report(make(ODD)))
    small = [(i, t) for i, t in ODD if i != 8]
    assert [x for x in got if x[0] != 8] == sorted(((i, expected(i, t)) for i, t in small), key=repr)
    assert [x[1][:5] for x in got if x[0] == 8] == [(1, 0, 30_000, 1, 30_000_000)]
    assert runs.report(make([])).collect() == []


def test_extra_columns_pass(make):
    found = runs.detect(make([(1, "a b " * 12)]).withColumnRenamed("t", "runs").withColumnRenamed("row", "period")).collect()[0]
    assert found["runs"] == [(0, 24, 2)] and found["collapsed"] == "a b" and found["n_words"] == 24 and found["period"] == "x" and found["score"] == "x"


def _piece(texts, least, times):
    import pyarrow as pa

    return runs._text_runs(pa.array(texts, pa.string()), least, times)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4), st.sampled_from([(2, 2), (4, 2), (6, 3)]))
def test_small_alphabets(texts, limits):
    least, times = limits
    n, found, left = _piece([" ".join(t) for t in texts], least, times)
    for t, k, own, rest in zip(texts, n, found, left):
        want = brute(list(t), least, times)
        assert k == len(t) and [(r["start"], r["length"], r["period"]) for r in own] == want
        gone = {j for a, length, q in want for j in range(a + q, a + length)}
        assert rest == " ".join(c for j, c in enumerate(t) if j not in gone)


def test_nested_and_long_periods():
    r = random.Random(3)
    for _ in range(30):
        inner = [r.choice("abc") for _ in range(r.randrange(1, 5))]
        outer = inner * r.randrange(3, 12) + [r.choice("abcd") for _ in range(r.randrange(0, 9))]
        words = [r.choice("abcdef") for _ in range(20)] + outer * r.randrange(3, 9) + [r.choice("abcdef") for _ in range(20)]
        fib = ["a", "ab"]
        while len(fib[-1]) < 300:
            fib.append(fib[-1] + fib[-2])
        for text in (words, list(fib[-1])):
            _, found, _ = _piece([" ".join(text)], 24, 3)
            assert [(x["start"], x["length"], x["period"]) for x in found[0]] == brute(text)


def test_same_words_in_two_texts_are_no_run():
    _, found, _ = _piece(["a b c d e f g h " * 2] * 5, 24, 3)
    assert found == [[]] * 5
