"""Each stage against a brute-force version on what its predecessor kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_decontaminate, test_jaccard_join, test_lines, test_packing
from tests.llm.conftest import ODD
from trialstats.llm import quality
from trialstats.llm.store import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_stages(spark, folder, documents, labels, benchmark_items):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "jaccard_groups", "decontamination", "packing"]

    good = stored(stages["quality"](spark, documents, folder), "t1")
    want = quality.quality(documents, labels).where("predicted = 1")
    assert good.columns == COLUMNS and sorted(rows(good)) == sorted(rows(documents.join(want.select("doc_id"), "doc_id")))
    assert 0 < documents.count() - good.count() < documents.count() / 2

    clean = stored(stages["line_dedup"](spark, good, folder), "t2")
    before, got = dict(rows(good)), dict(rows(clean))
    texts = test_lines.brute(list(before.items()))
    assert clean.columns == COLUMNS and clean.where(F.col("n_chars") != F.length("text")).isEmpty()
    test_lines.agree({i: got.get(i, "") for i in before}, {i: t if t.strip(" \t\n\x0b\f\r") else "" for i, t in texts.items()})
    assert all(texts[i].strip(" \t\n\x0b\f\r") == "" for i in set(before) - set(got))

    one = stored(stages["jaccard_groups"](spark, clean, folder), "t3")
    groups = test_jaccard_join.brute(rows(clean))
    assert one.columns == COLUMNS and sorted(i for i, _ in rows(one)) == sorted(i for i, (n, c) in groups.items() if i == c)

    apart = stored(stages["decontamination"](spark, one, folder), "t4")
    gone = {i for i, _ in rows(one)} - {i for i, _ in rows(apart)}
    leaks = {i for i, _ in test_decontaminate.brute(rows(one), [(r["item_id"], r["text"]) for r in benchmark_items.collect()])}
    assert apart.columns == COLUMNS and gone == leaks

    packed = stages["packing"](spark, apart, folder).collect()
    test_packing.check(packed, [(i, len(t.split())) for i, t in rows(apart)], 2048, 65_536)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "chunk", "n_tokens", "bucket", "batch"} <= set(out.columns) and out.count() > 0


def test_odd_rows(spark, folder, make):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, make(ODD).select(COLUMNS), folder)
        assert out.count() > 0, name
        assert stage(spark, make([]).select(COLUMNS), folder).count() == 0, name
    kept = corpus_pipeline.jaccard_groups(spark, make(ODD).select(COLUMNS), folder)
    assert kept.where("doc_id = 7").count() == 2  # repeated rows once, the other text too: the id stands for both


def test_texts_that_stay_are_not_shuffled(spark, folder, make, monkeypatch):
    """Only rows that may go, or whose id is there twice, are sent with their texts."""
    parts, parted = [], corpus_pipeline.parted
    monkeypatch.setattr(corpus_pipeline, "parted", lambda *given: parts.append(parted(*given)) or parts[-1])
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(f"x{k}y{j}" for j in range(30))) for k in range(20)] + [(100 + k, " ".join([*base[:k], "own", *base[k + 1 :]])) for k in (0, 1, 59)]
    rows += [(30, "twice the same"), (30, "twice the same"), (31, "one text"), (31, "another text"), (40, None), (41, ""), (None, "no id"), (None, "no id"), (None, "nor here")]
    kept = corpus_pipeline.jaccard_groups(spark, make(rows).select(COLUMNS), folder)
    gone = {rows.index(r) for r in rows if r[0] in (101, 159)} | {rows.index((30, "twice the same")) + 1, rows.index((None, "no id")) + 1}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert kept.columns == COLUMNS
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=key) == sorted((r for k, r in enumerate(rows) if k not in gone), key=key)
    ((some, others),) = parts
    assert {r["doc_id"] for r in others.collect()} == {*range(20), 40, 41, 100} and some.count() + others.count() == len(rows)
