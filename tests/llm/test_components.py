import random

from trialstats.llm.components import components


def brute(edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in root}


def test_against_definition(spark):
    r = random.Random(1)
    path = [(k, k + 1) for k in range(40)]
    star = [(1000, k) for k in range(100, 300)]
    loose = [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)]
    for edges in (path, star, path + star + loose + loose[:5] + [(5000, 5000), (-7, 3)], [(9, 9)]):
        frame = spark.createDataFrame(edges, "a long, b long")
        got = {x["node"]: x["component"] for x in components(frame).collect()}
        assert got == brute(edges)
    nulls = spark.createDataFrame([(None, 1), (2, None), (3, 4)], "a long, b long")
    assert sorted(map(tuple, components(nulls).collect())) == [(3, 3), (4, 3)]
    assert components(nulls.limit(0)).collect() == []


def test_few_edges_take_one_step_and_many_the_same_result(spark, monkeypatch):
    """What fits into a task is contracted there, without rounds; more edges go through the rounds."""
    from trialstats.llm import components as module

    r = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(900, 1100)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(120)] + [(3000, 3000)]
    r.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(8)
    tables, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda *a: tables.append(a) or stored(*a))
    got = {x["node"]: x["component"] for x in components(frame).collect()}
    assert got == brute(edges) and len(tables) == 2
    monkeypatch.setattr(module, "EDGES", 100)
    found = [tuple(x) for x in components(frame).collect()]
    assert len(tables) > 5 and len(found) == len(got) and dict(found) == got
