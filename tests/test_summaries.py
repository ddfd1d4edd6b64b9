"""Missing-value rules of summaries, quantiles and permutations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialstats.operators import summaries
from trialstats.operators.relational import stack_tasks
from trialstats.operators.orderstats import order_statistics, qq_points, quantiles
from trialstats.operators.permute import shuffle_column


def frame(spark):
    rows = [("a", 1.0, 10.0), ("a", 0.0, 20.0), ("b", 1.0, None), ("b", 0.0, 5.0), ("c", 1.0, 7.0), (None, 0.0, 1.0)]
    return spark.createDataFrame(rows, "g string, correct double, TimeOnTask double")


def test_group_summary(spark):
    got = {r["g"]: r.asDict() for r in summaries.group_summary(frame(spark), ["g"], "TimeOnTask").collect()}
    assert got["a"]["mean"] == 15 and math.isclose(got["a"]["sd"], math.sqrt(50))
    assert math.isclose(got["a"]["se"], 5.0)
    # One NULL makes mean and sd NULL, but the row is counted.
    assert (got["b"]["mean"], got["b"]["sd"], got["b"]["n"]) == (None, None, 2)
    # A single row has no spread; the NULL group is kept.
    assert (got["c"]["sd"], got["c"]["se"]) == (None, None)
    assert got[None]["n"] == 1


def test_na_rm_variant(spark):
    got = frame(spark).groupBy("g").agg(summaries.mean(F.col("TimeOnTask"), na_rm=True).alias("m")).collect()
    assert {r["g"]: r["m"] for r in got}["b"] == 5.0


def test_multi_mean_skips_nulls_and_the_null_key(spark):
    got = {r["g"]: r["mean_TimeOnTask"] for r in summaries.multi_mean(frame(spark), "g", ["TimeOnTask"]).collect()}
    assert got == {"a": 15.0, "b": 5.0, "c": 7.0}


def test_stacked_summary_equals_stacked_summaries(spark):
    rows = [("A", "x", 1.0), ("A", "x", 0.0), ("A", None, 1.0), ("B", "x", None), ("B", "y", 3.0), (None, "y", 4.0)]
    df = spark.createDataFrame(rows, "task string, g string, v double")
    frames = {t: summaries.group_summary(df.filter(F.col("task") == t), ["g"], "v") for t in "AB"}
    want = stack_tasks(frames).select("category", "g", "mean", "sd", "n", "se").collect()
    got = summaries.stacked_summary(df, "task", ["g"], "v").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 4


def test_contingency_ignores_nulls(spark):
    got = {(r["g"], r["correct"]): r["n"] for r in summaries.contingency(frame(spark), "g", "correct").collect()}
    assert got == {("a", 0.0): 1, ("a", 1.0): 1, ("b", 0.0): 1, ("b", 1.0): 1, ("c", 1.0): 1}
    wide = summaries.contingency_wide(frame(spark), "g", "correct", [0.0, 1.0]).orderBy("g").collect()
    assert [tuple(r) for r in wide] == [("a", 1, 1), ("b", 1, 1), ("c", 0, 1)]


def test_learning_curve(spark):
    rows = [("p", 1, 1.0), ("p", 1, 0.0), ("p", 3, 1.0), ("p", None, 1.0), ("q", 2, None)]
    df = spark.createDataFrame(rows, "participant string, block int, correct double")
    got = {(r[0], r[1]): r["mean"] for r in summaries.learning_curve(df, "participant", "block").collect()}
    assert got == {("p", 1): 0.5, ("p", 3): 1.0, ("q", 2): None}


def test_error_band(spark):
    df = spark.createDataFrame([("a", 0.8266, 0.1)], "g string, mean double, se double")
    row = summaries.error_band(df).first()
    assert row["label"] == "83%" and math.isclose(row["lower"], 0.7266) and math.isclose(row["upper"], 0.9266)


@pytest.mark.parametrize("read_off", [50_000, 20, 0])
@pytest.mark.parametrize("sketch, slack", [(1 << 14, 1.5), (8, 0.5), (8, 0.0)])
def test_quantiles_match_numpy(spark, read_off, sketch, slack):
    """Also when nearly all rows share one value, outliers stretch the range, and ranks miss their brackets."""
    rng = random.Random(5)
    values = [5.0] * 700 + [rng.gauss(0, 1) for _ in range(900)] + [1e9, -1e12] + [float(rng.randrange(50)) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    probabilities = [0.0, 0.001, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = quantiles(df, "x", probabilities, read_off=read_off, sketch=sketch, slack=slack)
    want = np.quantile(np.array(values), probabilities)
    assert np.allclose([got[p] for p in probabilities], want, rtol=1e-12, atol=0)


def test_order_statistics_at_the_limits_of_doubles(spark):
    values = [-1.7e308, 1.7e308, math.inf, -math.inf, 0.0, 5e-324, 1e-323, -5e-324] * 5 + [float("nan")] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = order_statistics(df, "x", lambda n: range(n), read_off=0)
    assert [got[k] for k in range(40)] == sorted(values[:40])


def test_quantiles_scan_the_source_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x")).mapInArrow(count, "x double")
    got = quantiles(df, "x", [0.1, 0.5, 0.9], read_off=10)
    values = np.arange(200_000) * 7919 % 200_003
    assert np.allclose([got[p] for p in (0.1, 0.5, 0.9)], np.quantile(values, [0.1, 0.5, 0.9]), rtol=1e-12)
    assert seen.value == 400_000


def test_order_statistics_of_nothing(spark):
    assert order_statistics(spark.createDataFrame([(None,)], "x double"), "x", lambda n: [0]) == {}


def test_qq_points(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    rows = sorted(qq_points(df, "x", 5).collect())
    assert [round(r["prob"], 6) for r in rows] == [0.1, 0.3, 0.5, 0.7, 0.9]
    assert np.allclose([r["sample_quantile"] for r in rows], [10, 30, 50, 70, 90])
    assert abs(rows[2]["normal_quantile"]) < 1e-12 and math.isclose(rows[4]["normal_quantile"], 1.2815515655, rel_tol=1e-9)


def test_shuffle_column_permutes(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"), (F.col("id") % 7).alias("v"))
    one = shuffle_column(df, "k", "v", seed=1, digits=2)
    rows = {r["k"]: (r["x"], r["v"]) for r in one.collect()}
    assert len(rows) == 500 and all(x == 2 * k for k, (x, _) in rows.items())
    assert sorted(v for _, v in rows.values()) == sorted(k % 7 for k in range(500))
    assert sum(v == k % 7 for k, (_, v) in rows.items()) < 150
    # The permutation depends on the seed, not on partitioning or bucket count.
    again = {r["k"]: (r["x"], r["v"]) for r in shuffle_column(df.repartition(3), "k", "v", seed=1, digits=1).collect()}
    assert again == rows
    other = {r["k"]: (r["x"], r["v"]) for r in shuffle_column(df, "k", "v", seed=2).collect()}
    assert other != rows
