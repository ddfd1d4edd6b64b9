"""Natural joins: NULL keys, duplicates, and the layouts that must not change results."""

import pytest
from pyspark.sql import functions as F

from trialstats.operators.joins import natural_join, star_join, trials_with_instances

SLICED = {"slices": 5}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("layout", [{}, SLICED])
def test_null_keys_match(spark, layout):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "k int, y string")
    assert rows(natural_join(a, b, **layout)) == [(1, "a", "p"), (None, "b", "q")]


@pytest.mark.parametrize("layout", [{}, SLICED])
def test_plain_equality_on_request(spark, layout):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (4, "r")], "k int, y string")
    assert rows(natural_join(a, b, null_safe=False, **layout)) == [(1, "a", "p")]


def test_no_shared_columns_is_an_error(spark):
    with pytest.raises(ValueError):
        natural_join(spark.range(2).toDF("a"), spark.range(2).toDF("b"))


def test_extra_overlap_is_an_error(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    with pytest.raises(ValueError):
        natural_join(a, a, on=["k"])


def skewed(spark, n=3000):
    """One key with a third of the rows, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).cast("int")
    return spark.range(n).select(key.alias("k"), F.col("id").alias("v"))


def test_sliced_join_equals_plain_join(spark):
    left = skewed(spark)
    right = spark.createDataFrame([(k, k * 10 + j) for k in range(45) for j in range(2)], "k int, w int")
    assert rows(natural_join(left, right, **SLICED)) == rows(left.join(right, "k"))


def test_slices_spread_equal_rows(spark):
    """One key, two distinct contents: every slice gets its share."""
    from trialstats.operators import joins

    left = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("x")).repartition(4)
    right = spark.createDataFrame([(1, "a")], "k int, y string")
    kept = []
    plain = joins._join
    joins._join = lambda *a: kept.append(plain(*a)) or kept[-1]
    try:
        assert natural_join(left, right, slices=16).count() == 20_000
    finally:
        joins._join = plain
    shares = [r["count"] for r in kept[0].groupBy(joins.SLICE).count().collect()]
    assert len(shares) == 16 and max(shares) < 2 * min(shares)


def test_joins_are_lazy(spark, sf):
    """Building a query with several joins runs no job but those that read parquet schemas."""
    import __spark_entry__ as entry

    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    for name, tables in (("acc_by_region", 4), ("analysis_with_demographics", 8)):
        context.setJobGroup(f"lazy-{name}", name)
        try:
            entry.queries()[name](spark, sf)
            assert len(tracker.getJobIdsForGroup(f"lazy-{name}")) <= tables
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)


def test_star_join_equals_repeated_joins(spark):
    fact = skewed(spark).withColumn("m", (F.col("v") % 5).cast("int"))
    d1 = spark.createDataFrame([(k, f"a{k}") for k in range(45)], "k int, a string")
    d2 = spark.createDataFrame([(m, f"b{m}") for m in range(5)], "m int, b string")
    want = rows(fact.join(d1, "k").join(d2, "m").select("m", "k", "v", "a", "b"))
    assert rows(star_join(fact, d1, d2).select("m", "k", "v", "a", "b")) == want


def test_repeated_instances_do_not_multiply_trials(spark):
    trials = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "trial int, inst int")
    instances = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 5.0), (2, 6.0)], "inst int, type double")
    got = rows(trials_with_instances(trials, instances))
    assert got == [(1, 1, 3.0), (1, 2, 3.0), (2, 3, 5.0), (2, 3, 6.0)]
