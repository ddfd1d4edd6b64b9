import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ODD
from trialstats.llm import substrings


def brute(rows):
    """kept words by definition; rows are (doc_id, text) with distinct ids"""
    split = {i: re.findall(r"[^ \t\n\x0b\f\r]+", t or "") for i, t in rows}
    first = {}
    places = defaultdict(list)
    for i in sorted(split):
        for k in range(len(split[i]) - 19):
            places[tuple(split[i][k : k + 20])].append((i, k))
    gone = defaultdict(set)
    for found in places.values():
        for i, k in found[1:]:
            gone[i].update(range(k, k + 20))
    return {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[i]).encode()).hexdigest()) for i, w in split.items()}


def test_against_definition(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.report(documents).collect()}
    assert got == brute(rows)
    assert any(v[1] for v in got.values())


def test_planted_and_periodic(make):
    import random

    r = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for k in range(120):
        own = [r.choice(words) for _ in range(r.randrange(0, 80))]
        cut = r.randrange(0, 15)
        rows.append((k, " ".join(own + (passage[cut:] if k % 2 else passage) + own[::-1])))
    rows += [(200, "a b c " * 40), (201, "b c a " * 30), (202, " ".join(passage * 3)), (203, "z " * 100)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.report(make(rows)).collect()}
    assert got == brute(rows)


def test_hot_minimizers_are_cut(make, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_BITS", 4)
    import random

    r = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"{r.random()} {r.random()} {passage} {r.random()} " + " ".join(f"q{k}x{j}" for j in range(30))) for k in range(90)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.report(make(rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(make):
    out = substrings.report(make(ODD)).collect()
    assert len(out) == len(ODD)
    assert sorted((r["n_words"], r["n_removed"]) for r in out if r["doc_id"] in (7,)) == [(4, 0), (4, 0), (6, 0)]
    long = next(r for r in out if r["doc_id"] == 8)
    assert (long["n_words"], long["n_removed"]) == (30_000, 29_999 - 0)  # only the first word has no earlier window over it
    assert substrings.report(make([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14))
def test_matching_statistics(added, text):
    shard = substrings.Automaton()
    for sequence in added:
        shard.add(sequence)
    parts = {tuple(s[i:j]) for s in added for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    want = [max(k for k in range(e + 2) if k == 0 or tuple(text[e + 1 - k : e + 1]) in parts) for e in range(len(text))]
    assert shard.matches(text) == want
