import random
from collections import defaultdict

from tests.llm.conftest import ODD
from trialstats.llm import lines


def shingled(x):
    return {x[j : j + 5] for j in range(len(x) - 4)} if len(x) >= 5 else {x}


def jaccard(x, y):
    x, y = shingled(x), shingled(y)
    return len(x & y) / len(x | y)


def brute(rows, threshold=0.75):
    """doc_id -> text by definition: components of all line pairs; ids are distinct"""
    blank = b" \t\n\x0b\f\r"
    cut = {i: [x.encode().strip(blank) for x in (t or "").split("\n")] for i, t in rows}
    first = {}
    for i in sorted(cut):
        for k, x in enumerate(cut[i]):
            if x:
                first.setdefault(x, (i, k))
    sets = {x: shingled(x.decode()) for x in first}
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for x, s in sets.items():
        for y in {y for p in s for y in holders[p]}:
            both = len(s & sets[y])
            if both >= threshold * (len(s) + len(sets[y]) - both):
                root[find(x)] = find(y)
        for p in s:
            holders[p].append(x)
    kept = {}
    for x, place in first.items():
        kept[find(x)] = min(kept.get(find(x), place), place)
    return {i: "\n".join(raw for k, (raw, x) in enumerate(zip((t or "").split("\n"), cut[i])) if not x or kept[find(x)] == (i, k)) for i, t in rows}


def result(frame):
    return {r["doc_id"]: r["text"] or "" for r in lines.deduplicated(frame).collect()}


def agree(got, want):
    """MinHash may miss a tenth of the lines that near-equal ones come before, but never removes too much."""
    assert got.keys() == want.keys()
    assert all(set(want[i].split("\n")) <= set(got[i].split("\n")) or got[i] == want[i] for i in got)


def fuzzy_recall(rows, got, want):
    """The share of lines to remove, other than repeats of equal lines, that are removed."""
    seen, due, done = set(), 0, 0
    for i, t in sorted(rows):
        left, right = set(got[i].split("\n")), set(want[i].split("\n"))
        for x in (t or "").split("\n"):
            if x.strip(" \t\x0b\f\r") in seen or not x.strip():
                continue
            seen.add(x.strip(" \t\x0b\f\r"))
            due += x not in right
            done += x not in right and x not in left
    return due, done


def test_against_definition(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got, want = result(documents), brute(rows)
    agree(got, want)
    due, done = fuzzy_recall(rows, got, want)
    assert due >= 20 and done >= 0.9 * due


def test_families(make):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    bases = [[word() for _ in range(r.randrange(1, 90))] for _ in range(25)]
    rows = []
    for k in range(120):
        text = []
        for _ in range(r.randrange(0, 8)):
            line = list(r.choice(bases)) if r.random() < 0.7 else [word() for _ in range(r.randrange(1, 30))]
            if r.random() < 0.5:
                line[r.randrange(len(line))] = word()
            text.append(" ".join(line) + r.choice(["", " ", "\r"]))
        rows.append((k, "\n".join(text) + r.choice(["", "\n", "\n\n"])))
    got, want = result(make(rows)), brute(rows)
    agree(got, want)
    due, done = fuzzy_recall(rows, got, want)
    assert due >= 50 and done >= 0.95 * due


def test_repeated_line_in_many_documents(make):
    rows = [(k, f"the line that everybody has\nown {k * 7919} words {k ** 3} of document {k * 31}\n") for k in range(300)]
    got = result(make(rows))
    assert sum("everybody" in t for t in got.values()) == 1 and "everybody" in got[0]


def test_odd_rows(make):
    frame = make(ODD)
    out = lines.deduplicated(frame)
    assert out.columns == [*frame.columns, "n_lines_removed"] and out.count() == len(ODD)
    assert sorted(r["n_lines"] for r in lines.report(frame).collect() if r["doc_id"] in (1, 2, 3, 5)) == [0, 0, 0, 1]
    assert lines.report(make([])).collect() == []


def pairs_found(make, pairs):
    """Of pairs of lines, each in two documents of its own, how many lose the second."""
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    got = result(make(rows))
    assert all(got[2 * k] for k in range(len(pairs)))
    return sum(not got[2 * k + 1] for k in range(len(pairs)))


def noise(r, n, letters="abcdefghijklmnopqrstuvwxyz    "):
    return "x" + "".join(r.choice(letters) for _ in range(n - 2)) + "x"


def test_links_across_all_lengths(make):
    """Pairs around every power of two, the second a little longer, at a similarity of 0.75 to 0.99."""
    r = random.Random(5)
    pairs = []
    for n in (16, 32, 64, 128, 256, 260, 512, 1024, 4096):
        while sum(len(p[0]) == n for p in pairs) < 30:
            base = noise(r, n)
            at = r.randrange(3, n - 3)
            other = base[:at] + noise(r, r.randrange(3, max(4, n // 30 + 3))) + base[at:]
            if jaccard(base, other) >= 0.75:
                pairs.append((base, other))
            elif n == 16:
                pairs.append((base, base + base[-1]))
    assert pairs_found(make, pairs) >= 0.95 * len(pairs)


def test_one_character_edits(make):
    """A line of 40 and more characters with one of them changed, also outside ASCII, is still the same line."""
    r = random.Random(6)
    pairs = []
    for letters in ("abcdefghijklmnopqrstuvwxyz ", "абвгдежзиклмнопрстуфхцч ", "漢字仮名交文日本語中国 "):
        for n in (40, 45, 50, 60):
            for _ in range(25):
                base = noise(r, n, letters)
                at = r.randrange(8, n - 8)
                other = base[:at] + ("q" if letters[0] == "a" else "Q") + base[at + 1 :]
                if base != other and jaccard(base, other) >= 0.75:
                    pairs.append((base, other))
    assert len(pairs) >= 250 and pairs_found(make, pairs) >= 0.95 * len(pairs)


def test_similarity_at_the_threshold(make):
    """0.75 to 0.8 only: the chance to meet in a band is 0.989 there."""
    r = random.Random(7)
    pairs = []
    while len(pairs) < 300:
        base = noise(r, r.randrange(60, 300))
        other = base
        while jaccard(base, other) >= 0.8:
            at = r.randrange(len(other))
            other = other[:at] + r.choice("ABCDEFGH") + other[at + 1 :]
        if jaccard(base, other) >= 0.75:
            pairs.append((base, other))
    assert pairs_found(make, pairs) >= 0.95 * len(pairs)


def test_variants_that_are_no_copies_of_the_first(make, monkeypatch):
    """Chains of near lines whose ends are far apart are one component, also when bands are crowded."""
    r = random.Random(8)
    chains, rows = 12, []
    for c in range(chains):
        line = list(noise(r, 200))
        for step in range(12):
            rows.append((c * 100 + step, "".join(line)))
            for at in r.sample(range(200), 4):
                line[at] = r.choice("ABCDEFGH")
    want = brute(rows)
    for crowd in (4096, 3):
        monkeypatch.setattr(lines, "CROWD", crowd)
        got = result(make(rows))
        agree(got, want)
        assert sum(bool(t) for t in got.values()) <= sum(bool(t) for t in want.values()) + 1


def test_nothing_stored_is_left_but_the_result(spark, make):
    import os

    from trialstats.llm.store import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    lines.deduplicated(make([(k, f"line {k} of many\nthe same for all") for k in range(30)])).count()
    assert len(set(os.listdir(folder)) - before) <= 1


def test_crowded_band_whose_lines_meet_only_there(spark, make, monkeypatch):
    """Near lines that share a single band are all compared when it is crowded, too."""
    import numpy as np
    import pyarrow as pa

    bands = lines._bands

    def one_band(batches):
        for batch in bands(batches):
            line, k = batch.column("id").to_numpy(), np.arange(len(batch)) % lines.BANDS
            band = np.where(k == 0, 1, line * 31 + k)
            yield pa.RecordBatch.from_arrays([pa.array(band), batch.column("id"), batch.column("sketch")], ["band", "id", "sketch"])

    r = random.Random(9)
    rows = []
    for k in range(40):
        base = noise(r, 200)
        rows += [(3 * k, base), (3 * k + 1, base[:100] + "Q" + base[101:]), (3 * k + 2, noise(r, 200))]
    monkeypatch.setattr(lines, "_bands", one_band)
    for crowd in (4096, 7):
        monkeypatch.setattr(lines, "CROWD", crowd)
        found = lines.line_components(make(rows).select("text"), 0.75).collect()
        assert len(found) == 80 and len({f["component"] for f in found}) == 40


def test_one_pass_over_the_texts_for_all_comparisons(make, monkeypatch):
    """The lines of both rounds come from one pass."""
    passes, texts = [], lines._texts
    monkeypatch.setattr(lines, "_texts", lambda *a: passes.append(1) or texts(*a))
    r = random.Random(10)
    base = noise(r, 300)
    near = [base[:at] + "Q" + base[at + 1 :] for at in range(5, 290, 15)]
    got = result(make([*enumerate(near), *((k, noise(r, 200)) for k in range(100, 120))]))
    assert sum(bool(t) for t in got.values()) == 21 and len(passes) == 1


def test_bands_travel_in_blocks():
    """A row for each bucket, not for each line and band; every line of every band is in one."""
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["\n".join(f"line {k} of text {t}, {k * t}" for k in range(40)) for t in range(50)]})
    plain = [x for b in lines._bands([batch]) for x in zip(*(b.column(k).to_pylist() for k in ("band", "id", "sketch")))]
    blocks = [x for b in lines._blocked(lines._bands, 16)([batch]) for x in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist())]
    assert len(blocks) == 16 and len(plain) >= 12 * 1900
    assert sorted(tuple(row) for _, data in blocks for row in np.frombuffer(data, np.int64).reshape(-1, 3).tolist()) == sorted(plain)
    assert all(int(band) * 16 >> 64 == bucket for bucket, data in blocks for band in np.frombuffer(data, np.uint64)[::3])


def test_lines_ids_and_shingles_by_definition():
    import pyarrow as pa

    r = random.Random(11)
    texts = ["".join(r.choice("ab cdé ñ漢\U0001f600字\n \t") for _ in range(r.randrange(60))) for _ in range(800)] + [" " * 50 + "a b" + " " * 50, "x" * 5000]
    want = [(i, k, x.strip(b" \t\n\r\x0b\x0c")) for i, t in enumerate(texts) for k, x in enumerate(t.encode().split(b"\n"))]
    want = [w for w in want if w[2]]
    data, row, number, a, b = lines.lines(pa.array(texts))
    assert [(i, k, data[x:y].tobytes()) for i, k, x, y in zip(row.tolist(), number.tolist(), a, b)] == want
    ids = lines.line_ids(data, a, b)
    assert len({(w[2], i) for w, i in zip(want, ids.tolist())}) == len({w[2] for w in want}) == len(set(ids.tolist()))
    hashes, starts = lines.shingles_of(data, a, b, ids)
    seen = set()
    for (_, _, line), x, y in zip(want, starts[:-1], starts[1:]):
        own = line.decode()
        own = [own[j : j + 5] for j in range(len(own) - 4)] or [own]
        assert len(own) == y - x
        seen.update(zip(own, hashes[x:y].tolist()))
    assert len(seen) == len({s for s, _ in seen}) == len({h for _, h in seen})


def test_documents_that_lose_nothing_are_not_sent(make, monkeypatch):
    """Only documents with a line that goes are joined with the lines' numbers."""
    parts, parted = [], lines.parted
    monkeypatch.setattr(lines, "parted", lambda *given: parts.append(parted(*given)) or parts[-1])
    frame = make([(k, f"x{k * 7919} of its own {k * 104729}") for k in range(20)] + [(50, "a line that is there twice"), (51, "first\na line that is there twice"), (52, None), (None, "no id"), (None, "no id")])
    got = {(r["doc_id"], r["text"], r["n_lines_removed"]) for r in lines.deduplicated(frame).collect()}
    assert {(51, "first", 1), (50, "a line that is there twice", 0), (52, None, 0), (None, "no id", 0)} <= got and len(got) == 24
    ((some, others),) = parts
    assert [r["doc_id"] for r in some.collect()] == [51] and others.count() == 24


def test_places_travel_with_the_bands():
    """One pass gives bands and places; of a line in all documents a task sends one place by id, the others by document."""
    import numpy as np
    import pyarrow as pa

    rows = [(t, 7 * t, "the line that everybody has\n" + f"own line {t * 7919} of {t ** 3}\n" * 2) for t in range(50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "t": [r[1] for r in rows], "text": [r[2] for r in rows]})
    first, again = [], []
    for b in lines._blocked(lines._bands, 4)([batch, batch]):  # a row that is there twice counts once
        for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()):
            if 4 <= bucket < 8:
                first += np.frombuffer(data, np.int64).reshape(-1, 4)[:, 1:].tolist()
            elif bucket >= 8:
                again += np.frombuffer(data, np.int64).reshape(-1, 3).tolist()
    assert sorted(first) == sorted([[0, 0, 0], *([t, 7 * t, 1] for t in range(50))])
    assert sorted(again) == sorted([*([t, 7 * t, 0] for t in range(1, 50)), *([t, 7 * t, 2] for t in range(50))])


def test_two_passes_over_the_texts(make, monkeypatch):
    """Places come with the bands: the texts are hashed for these and for the lines to compare, not again for the places."""
    steps, stored = [], lines.stored
    monkeypatch.setattr(lines, "stored", lambda frame, name: steps.append(name) or stored(frame, name))
    lines.dropped(make([(k, f"line {k} of many\nthe same for all") for k in range(30)])).count()
    assert steps.count("bands") == 1 and steps.count("lines") == 1 and "occurrences" not in steps


def test_blank_lines_are_not_counted(make):
    text = "a\n \t\n\n!\n  x\n\x0b\f\r\n\x01\né\n\u00a0\n"
    (row,) = lines.report(make([(1, text)])).collect()
    assert (row["n_lines"], row["n_removed"]) == (6, 0)


def test_links_between_components_of_the_first_round(make, monkeypatch):
    """The second round's links join whole components, and lines that had no link before."""

    def none(threshold):
        return lambda batches: iter(())

    r = random.Random(12)
    chains = []
    for c in range(8):
        line = list(noise(r, 160))
        for step in range(10):
            chains.append((c * 100 + step, "".join(line)))
            for at in r.sample(range(160), 3):
                line[at] = r.choice("ABCDEFGH")
    want = brute(chains)
    # nothing is compared in the first round
    monkeypatch.setattr(lines, "_checked", none)
    monkeypatch.setattr(lines, "ALL", 1)
    got = result(make(chains))
    agree(got, want)
    assert sum(bool(t) for t in got.values()) <= sum(bool(t) for t in want.values()) + 1
    monkeypatch.setattr(lines, "_joined", none)
    assert sum(bool(t) for t in result(make(chains)).values()) > 70
