import itertools
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ODD
from trialstats.llm import packing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_least_padding(histogram, buckets):
    v, c = np.array(list(histogram)), np.array(list(histogram.values()))
    cost = lambda ends: sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())
    got = packing.bounds(v, c, buckets)
    assert len(got) <= buckets and got[-1] == v.max()
    others = [[*some, v.max()] for k in range(min(buckets, len(v))) for some in itertools.combinations(sorted(v)[:-1], k)]
    assert cost(got) == min(map(cost, others))


def check(rows, lengths, longest, budget):
    """lengths: words of each document, one entry for each row"""
    got = defaultdict(int)
    batches = defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
        assert 0 <= r["n_tokens"] <= min(longest, r["bound"]) and r["padding"] == r["bound"] - r["n_tokens"]
        batches[r["bucket"], r["bound"], r["batch"]].append(r["place"])
    want = defaultdict(int)
    for i, n in lengths:
        want[i] += n
    assert got == want
    assert len(rows) == sum(max(1, -(-n // longest)) for _, n in lengths)
    last = {b: max(k for x, _, k in batches if x == b) for b, _, _ in batches}
    for (b, bound, k), places in batches.items():
        room = max(1, budget // max(bound, 1))
        assert sorted(places) == list(range(len(places))) and len(places) <= room
        assert k == last[b] or len(places) == room


def test_all_documents(documents):
    lengths = [(r["doc_id"], len(r["text"].split())) for r in documents.collect()]
    check(packing.pack(documents).collect(), lengths, 2048, 65_536)
    check(packing.pack(documents, buckets=3, longest=100, budget=1000).collect(), lengths, 100, 1000)


def test_odd_rows(make):
    lengths = [(i, len((t or "").split())) for i, t in ODD]
    check(packing.pack(make(ODD)).collect(), lengths, 2048, 65_536)
    assert packing.pack(make([])).collect() == []
