import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from trialstats.llm import pii

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            v = m.group()
            digits = re.sub("[^0-9]", "", v)
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in v.split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end(), v))
    return sorted(out)


def described(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def context(text, span):
    a, b = span[0], span[2]
    low = max(a - pii.REACH, 0)
    left = [(m.start() + low, m.end() + low, m.group().lower()) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text[low:a])]
    right = [(m.start() + b, m.end() + b, m.group().lower()) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text[b : b + pii.REACH])]
    left = left[1:] if low else left
    right = right[:-1] if b + pii.REACH < len(text) else right
    return [w for w in left[-pii.SIDE :] + right[: pii.SIDE] if any(c.isalpha() for c in w[2]) and not re.search("[0-9@]", w[2])]


def brute(rows, support=3, generalise=0.5):
    """doc_id -> (digest of base spans, all spans); ids are distinct"""
    found = {i: base(t) for i, t in rows}
    texts = dict(rows)
    both, kinds, entity, term = defaultdict(set), defaultdict(set), defaultdict(set), Counter()
    for i, t in rows:
        term.update(set(re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower())))
        for s in found[i]:
            e = (s[1], s[3].lower())
            entity[e].add(i)
            for w in context(t, s):
                both[e, w[2]].add(i)
                kinds[e, w[2]].add(t)
    out = {}
    for i, t in rows:
        extra = set()
        for s in found[i]:
            e = (s[1], s[3].lower())
            prior = len(entity[e]) / len(rows)
            for w in context(t, s):
                if len(kinds[e, w[2]]) >= support and term[w[2]] and prior < 1:
                    given_ = min(1.0, len(both[e, w[2]]) / term[w[2]])
                    if 1 - math.log(given_) / math.log(prior) >= generalise:
                        extra.add((w[0], 4, w[1]))
        out[i] = (hashlib.sha256(described(found[i]).encode()).hexdigest(), described(sorted([(a, k, b) for a, k, b, _ in found[i]] + list(extra))))
    return out


def result(frame):
    return {r["doc_id"]: (r["base_sha256"], r["spans"]) for r in pii.report(frame).collect()}


def test_against_definition(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert result(documents) == brute(rows)


def test_terms_near_entities(make):
    r = random.Random(1)
    common = ["the", "of", "and", "call", "it", "was"]
    rows = []
    for k in range(60):
        person = k % 6
        words = [r.choice(common) for _ in range(12)]
        words[5:6] = [f"Surname{person}x".replace("0", "o").translate(str.maketrans("012345", "abcdef")), f"user{person}@mail{person}.example.org", "phone", f"+49 30 123{person}567{person}"]
        rows.append((k, " ".join(words) + f" {k}"))
    rows += [(100 + k, " ".join(r.choice(common) for _ in range(20))) for k in range(60)]
    want = brute(rows)
    frame = make(rows)
    assert result(frame) == want
    assert any("term:" in s for _, s in want.values())
    found = pii.spans(frame)
    clean = {x["doc_id"]: x["text"] for x in pii.sanitised(frame, found).collect()}
    assert len(clean) == len(rows) and clean[100] == dict(rows)[100]
    assert "[EMAIL]" in clean[0] and "[PHONE]" in clean[0] and "@" not in clean[0] and "surname" not in clean[0].lower()


def test_edges_of_the_patterns(make):
    texts = [
        "a@b.c_x@d.e a@b a@b. .@-.- x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
        "+1 (234) 567-8901 +1+2 345 678 9012 + 1 +12345678901234567", "é漢@x.y \U0001f600 a@b.cd 4111111111111111", "12345678901234567890123 79927398713 +00000000000000",
        "a" * 50_000, "1 " * 20_000, "a." * 20_000 + "@" + "b." * 3000, "1." * 30_000, "+1" + " " * 30_000,
    ]
    rows = list(enumerate(texts))
    assert result(make(rows)) == brute(rows)


def test_many_matches_in_a_text(make):
    """Time grows with the length of a text, not with its square."""
    rows = [(1, " ".join(str(10 + k % 90) + "x" * (k % 3) for k in range(40_000))), (2, "a@b.cc " * 20_000), (3, "1.2.3.4 " * 20_000)]
    frame = make(rows)
    started = time.time()
    got = frame.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect()
    assert time.time() - started < 30
    assert {r["doc_id"]: [tuple(s) for s in r["s"]] for r in got} == {i: base(t) for i, t in rows}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab1234567890@.+-() _\n\té", max_size=60), min_size=1, max_size=40))
def test_random_texts(make, texts):
    rows = list(enumerate(texts))
    assert {k: v[0] for k, v in result(make(rows)).items()} == {k: v[0] for k, v in brute(rows).items()}


def test_odd_rows(make):
    out = pii.report(make([*ODD, (20, "x@y.zz"), (20, "x@y.zz")])).collect()
    assert len(out) == len(ODD) + 2 and sum(r["n_email"] for r in out) == 2
    assert pii.report(make([])).collect() == []


def brute_whole(every, support=3, generalise=0.5):
    """doc_id -> places of the terms of whole texts; rows may repeat"""
    terms, with_entity = Counter(), Counter()
    both, texts = Counter(), defaultdict(set)
    unique = {(i, t) for i, t in every}
    found, words, held = {}, {}, {}
    for t in {t for _, t in every}:
        found[t] = base(t)
        words[t] = set(re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()))
        held[t] = {(s[1], s[3].lower()) for s in found[t]}
    for _, t in every:
        terms.update(words[t])
    for _, t in unique:
        # words that no blank divides from a span count as well
        beside = defaultdict(set)
        for s in found[t]:
            beside[s[1], s[3].lower()] |= {w for _, _, w in context(t, s)}
        for e in held[t]:
            with_entity[e] += 1
            for w in words[t] | beside[e]:
                both[e, w] += 1
                texts[e, w].add(t)
    rate = {}
    for (e, w), n in both.items():
        if len(texts[e, w]) >= support and terms[w] and with_entity[e] < len(every):
            rate[e, w] = 1 - math.log(min(1, n / terms[w])) / math.log(with_entity[e] / len(every))
    want = {}
    for i, t in unique:
        marks = set()
        for m in re.finditer(r"[^ \t\n\x0b\f\r]+", t or "") if held[t] else ():
            w = m.group().lower()
            if any(c.isalpha() for c in w) and not re.search("[0-9@]", w) and any(rate.get((e, w), -1) >= generalise for e in held[t]):
                marks.add((m.start(), m.end()))
        for s in found[t]:
            for a, b, w in context(t, s):
                if rate.get(((s[1], s[3].lower()), w), -1) >= generalise:
                    marks.add((a, b))
        want[i] = sorted(marks)
    return want


def test_whole_mode_on_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = pii.spans(documents, whole=True).select("doc_id", "terms").collect()
    assert {x["doc_id"]: [(m["start"], m["end"]) for m in x["terms"]] for x in got} == brute_whole(rows)


def test_terms_of_whole_texts(make):
    r = random.Random(2)
    common = ["the", "of", "and", "call", "it", "was", "then", "so"]
    filler = lambda n: [r.choice(common) for _ in range(n)]
    rows = []
    for k in range(40):
        name = "Surname" + "abcd"[k % 4]
        rows.append((k, " \n ".join([name, " ".join(filler(40)), f"mail:user{k % 4}@example.org", " ".join(filler(40)), name + "\t " + name.upper(), f"{k}"])))
    rows += [(100 + k, " ".join(filler(30))) for k in range(40)] + [(200, f"Surnamea {' '.join(filler(5))}")]
    frame = make([*rows, rows[0]])
    every = [*rows, rows[0]]
    want = brute_whole(every)
    found = pii.spans(frame, whole=True)
    got = found.collect()
    assert len(got) == len(every)
    assert {x["doc_id"]: [(m["start"], m["end"]) for m in x["terms"]] for x in got} == want
    assert len(want[0]) >= 3 and all(not want[k] for k in range(100, 140))
    clean = {x["doc_id"]: x["text"] for x in pii.sanitised(frame, found).collect()}
    assert all("surname" not in clean[k].lower() for k in range(40)) and "Surnamea" in clean[200]


def test_whole_odd_rows(make):
    out = pii.report(make([*ODD, (20, "x@y.zz"), (20, "x@y.zz")]), whole=True).collect()
    assert len(out) == len(ODD) + 2 and sum(r["n_email"] for r in out) == 2
    assert pii.report(make([]), whole=True).collect() == []
