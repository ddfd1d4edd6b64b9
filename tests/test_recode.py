"""Assignment semantics and every recode, on edge values."""

import pytest
from pyspark.sql import functions as F

from trialstats.operators import recode, relational


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


TYPES = [1.0, 2.0, 3.0, 4.0, 4.5, 5.0, 6.0, 7.0, None]


def test_last_write_wins_and_null_conditions_are_skipped(spark):
    def writes(x):
        return recode.assign([(x > 3, "a"), (x < 4, "b")])

    assert column(spark, [3.0, 3.5, 4.0, None], "double", writes) == ["b", "b", "a", None]


def test_in_phase_transition(spark):
    assert column(spark, TYPES, "double", recode.in_phase_transition) == ["No", "No", "Yes", "Yes", "No", "No", "No", "No", "No"]
    trimmed = column(spark, TYPES, "double", lambda x: recode.in_phase_transition(x, (4, 4.5)))
    assert trimmed == ["No", "No", "No", "Yes", "Yes", "No", "No", "No", "No"]


@pytest.mark.parametrize("task", ["knapsack", "sat", "tsp"])
def test_region(spark, task):
    hard, easy = recode.HARD_EASY[task]
    want = [easy, easy, hard, hard, None, "Over-Constrained", "Under-Constrained", None, None]
    assert column(spark, TYPES, "double", lambda x: recode.region(x, task)) == want


def test_trimmed_region(spark):
    got = column(spark, [3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, None], "double", recode.trimmed_region)
    assert got == ["Under-Constrained"] * 2 + ["Phase Transition"] * 2 + ["Over-Constrained"] * 2 + [None, None]


LABELS = ["Under-Constrained", "Over-Constrained", "Phase Transition", "Phase Transition - Hard", "PT", "other", None]


def test_relabel(spark):
    assert column(spark, LABELS, "string", recode.relabel) == ["Under", "Over", "PT", "PT", "PT", "other", None]
    exact = column(spark, LABELS, "string", lambda x: recode.relabel(x, "exact"))
    assert exact == ["Under", "Over", "PT", "Phase Transition - Hard", "PT", "other", None]


def test_difficulty(spark):
    assert column(spark, LABELS, "string", recode.difficulty) == [1.0, 2.0, 3.0, 3.0, 3.0, None, None]
    assert column(spark, LABELS, "string", lambda x: recode.difficulty(x, "exact")) == [1.0, 2.0, 3.0, None, None, None, None]


def test_flags(spark):
    assert column(spark, [3.0, 3.5, 4.0, None], "double", recode.postgrad) == [0, 0, 1, None]
    assert column(spark, [0.0, 1.0, 2.0, None], "double", recode.multiple_strategies) == [0, 0, 1, None]
    assert column(spark, ["Female", "Male", "Other", None], "string", lambda x: recode.binary_map(x, {"Female": 1, "Male": 0})) == [1, 0, None, None]
    assert column(spark, ["Commerce", "Arts", None], "string", lambda x: recode.dummy(x, "Commerce")) == [1, 0, None]


def test_trial_number_and_learning_block(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5), (None, 5)], "block int, trial int")
    number = recode.trial_number(F.col("block"), F.col("trial"), recode.BLOCK_OFFSETS["sat"])
    assert [r[0] for r in rows.select(number).collect()] == [5, 13, 21, None, None]
    assert column(spark, [6, 7, 12, 13, None], "int", recode.learning_block) == [1, 2, 2, 3, None]


def test_filters_drop_null_predicates(spark):
    rows = spark.createDataFrame([(1, 3), (0, 7), (None, 9), (2, None)], "flag int, inst int")
    assert sorted(r["solution"] for r in relational.split_yes_no(rows, "flag").collect()) == ["No", "Yes"]
    kept = relational.trim_instances(rows, "inst", [3, 7]).collect()
    assert sorted(str(r["inst"]) for r in kept) == ["9", "None"]
    late = rows.filter(relational.in_range(F.col("inst"), above=6, below=9)).collect()
    assert [r["inst"] for r in late] == [7]


def test_drop_cols_rejects_unknown_names(spark):
    rows = spark.createDataFrame([(1, 2)], "a int, b int")
    assert relational.drop_cols(rows, ["b"]).columns == ["a"]
    with pytest.raises(ValueError):
        relational.drop_cols(rows, ["c"])


def test_arrange_puts_nulls_last_and_is_total(spark):
    rows = spark.createDataFrame([(None, 1, "x"), (2, 1, "b"), (2, 1, "a"), (1, 9, "z")], "p int, t int, v string")
    got = [tuple(r) for r in relational.arrange(rows, ["p", "t"]).collect()]
    assert got == [(1, 9, "z"), (2, 1, "a"), (2, 1, "b"), (None, 1, "x")]


def test_bind_rows_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    c = spark.createDataFrame([(3, 4)], "b int, c int")
    got = sorted(relational.bind_rows(a, c).collect(), key=lambda r: r["b"])
    assert [tuple(r) for r in got] == [(1, 2, None), (None, 3, 4)]


def test_stack_tasks(spark):
    one = spark.createDataFrame([("Yes", 0.5)], "g string, mean double")
    got = relational.stack_tasks({"A": one, "B": one}).collect()
    assert sorted(r["category"] for r in got) == ["A", "B"]
