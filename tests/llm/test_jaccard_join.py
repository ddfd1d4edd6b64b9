import random
import re
from collections import defaultdict

from tests.llm.conftest import ODD
from trialstats.llm import jaccard_join


def sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    """doc_id -> (size, least id reachable); ids are distinct"""
    of = sets(rows)
    root = {i: i for i in of}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in of.items():
        for x in s:
            holders[x].append(i)
    for i, s in of.items():
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & of[j])
            if 100 * both >= 75 * (len(s) + len(of[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in of.items()}


def result(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(frame).collect()}


def test_against_definition(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got, want = result(documents), brute(rows)
    assert got == want
    assert any(c != i for i, (_, c) in got.items())


def family(seed, n, edits, length=60, vocabulary=4000):
    """n texts: edited copies, chains of edits, shared passages, short texts"""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    base, passage = [word() for _ in range(length)], [word() for _ in range(30)]
    rows, chain = [], base
    for k in range(n):
        kind = k % 5
        if kind == 0:
            t = list(base)
            for _ in range(r.randrange(edits + 1)):
                t[r.randrange(len(t))] = word()
        elif kind == 1:
            chain = list(chain)
            chain[r.randrange(len(chain))] = word()
            t = chain
        elif kind == 2:
            t = passage + [word() for _ in range(r.randrange(0, 25))]
        elif kind == 3:
            t = [word() for _ in range(r.randrange(1, 8))]
        else:
            t = base[: r.randrange(40, len(base) + 1)]
        rows.append((k * 3 % 1009, " ".join(t).upper() if k % 7 == 0 else " ".join(t)))
    return rows


def test_families(make):
    for seed in (1, 2):
        rows = family(seed, 250, 4)
        assert result(make(rows)) == brute(rows)


def test_small_hot_list_and_chunks(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 8)
    monkeypatch.setattr(jaccard_join, "CHUNK", 100)
    monkeypatch.setattr(jaccard_join, "QUERIES", 3)
    rows = family(3, 200, 5)
    assert result(make(rows)) == brute(rows)


def test_odd_rows(make):
    out = jaccard_join.join(make(ODD)).collect()
    assert len(out) == len(ODD)
    assert {r["component_id"] for r in out if r["doc_id"] == 2} == {2}
    assert sorted(r["n_shingles"] for r in out if r["doc_id"] == 7) == [1, 1, 2]
    assert jaccard_join.join(make([])).collect() == []


def test_unlinked_documents_that_share_a_passage(make, monkeypatch):
    """Documents too far apart for a link that share a passage are few groups for a shingle, not one each."""
    r = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(80):
        t = list(passage)
        for at in (r.randrange(5, 25), r.randrange(32, 55)):
            t[at] = f"own{k}x{at}"
        rows.append((k, " ".join(t)))
    matrices, stored = [], jaccard_join.stored

    def noted(frame, name):
        out = stored(frame, name)
        if name == "matrix" and "g2" in out.columns:
            matrices.append(out)
        return out

    monkeypatch.setattr(jaccard_join, "stored", noted)
    want = brute(rows)
    assert result(make(rows)) == want
    assert len({c for _, c in want.values()}) >= 8
    assert max(x["count"] for x in matrices[0].groupBy("token").count().collect()) <= 8


def test_sets_are_sent_and_not_stored(make, monkeypatch):
    """Sets, larger than the texts, go to where they are compared without a table of them."""
    names, stored = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda frame, name: names.append(name) or stored(frame, name))
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k] + [f"own{k}"] + base[k + 1 :])) for k in (0, 1, 58, 59)] + [(100 + k, " ".join(f"x{k}y{j}" for j in range(30))) for k in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(make(rows)).collect()}
    assert got == {0: 0, 1: 0, 58: 0, 59: 0} | {100 + k: 100 + k for k in range(5)}
    assert "shared" in names and "sets" not in names


def test_shared_shingles_come_from_blocks():
    import numpy as np

    from trialstats.llm import blocks

    rows = np.array([[8, 1], [8, 2], [8, 2], [12, 1], [18, 5], [20, 7], [20, 7]], np.int64)  # 8: two nodes; 18: hot; 12, 20: one node
    batches = list(blocks.packed(iter([(np.zeros(len(part), np.uint64), part) for part in (rows[:3], rows[3:])])))
    out = [x for b in jaccard_join._shared(iter(batches)) for x in zip(b.column("token").to_pylist(), b.column("node").to_pylist(), b.column("indexes").to_pylist())]
    assert [b.num_rows for b in batches] == [1] and sorted(out) == [(2, 1, False), (2, 2, False), (4, 5, False)]


def test_texts_are_sent_in_place_of_sets(make):
    """Where sets are compared they are made again, equal, from texts a good deal smaller."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(9)
    texts = [" ".join(r.choice(("Die", "größte", "of", "many", "words", "漢字", "here", "there")) + str(r.randrange(50)) for _ in range(n)) for n in (1, 4, 5, 900, 20_000)]
    rows = [*enumerate(texts), (10, None), (11, ""), (12, texts[3])]
    want = {jaccard_join.node_of(s): s for s in jaccard_join.shingle_sets(pa.array(texts))}
    nodes = make(rows).sparkSession.createDataFrame([(n,) for n in want], "node long")
    sent = jaccard_join.texts_of(make(rows).select("text"), nodes).toArrow()
    got = dict(zip(sent.column("node").to_pylist(), jaccard_join.sets_sent(sent)))
    assert got.keys() == want.keys() and all(np.array_equal(got[n], want[n]) for n in want)
    assert 2 * sum(map(len, sent.column("text").to_pylist())) < sum(8 * len(s) for s in want.values())
    assert jaccard_join.sets_sent(sent.slice(0, 0)) == []
