"""Chi-square, Welch and correlation tests from one grouped aggregation each."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialstats.functions.distributions import chi2_p, t_critical, t_p
from trialstats.operators.summaries import contingency

# Fixed value: 97.5 % point of the standard normal distribution.
Z_975 = 1.959963984540054


def chi2_test(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Pearson chi-square test of independence of two columns.

    Two-by-two tables get the continuity correction unless ``yates`` is off.
    A table with a single row or column has no test; its statistic is NULL.
    """
    cells = contingency(df, a, b)
    by_a, by_b = W.partitionBy(a), W.partitionBy(b)
    margins = cells.select(
        F.col("n").cast("double").alias("o"),
        F.sum("n").over(by_a).cast("double").alias("row"),
        F.sum("n").over(by_b).cast("double").alias("col"),
        F.count(F.lit(1)).over(by_a).alias("row_cells"),
        F.count(F.lit(1)).over(by_b).alias("col_cells"),
    )
    # Each row total appears once per non-empty cell of its row; dividing by
    # that number makes a sum over cells a sum over rows.
    totals = margins.agg(
        F.sum("o").alias("n"),
        F.round(F.sum(1 / F.col("row_cells"))).alias("rows"),
        F.round(F.sum(1 / F.col("col_cells"))).alias("cols"),
        F.sum(F.col("o") * F.col("o") / (F.col("row") * F.col("col"))).alias("share"),
        F.sum(1 / (F.col("row") * F.col("row_cells"))).alias("inv_rows"),
        F.sum(1 / (F.col("col") * F.col("col_cells"))).alias("inv_cols"),
        F.max(F.struct("o", "row", "col")).alias("cell"),
    )
    n, rows, cols = F.col("n"), F.col("rows"), F.col("cols")
    gap = F.abs(F.col("cell.o") - F.col("cell.row") * F.col("cell.col") / n)
    # In a 2x2 table all four cells have the same distance from expectation.
    reduced = gap - F.least(F.lit(0.5 if yates else 0.0), gap)
    square = reduced * reduced * n * F.col("inv_rows") * F.col("inv_cols")
    statistic = (
        F.when((rows < 2) | (cols < 2), F.lit(None).cast("double"))
        .when((rows == 2) & (cols == 2), square)
        .otherwise(n * (F.col("share") - 1))
    )
    tested = totals.select(
        statistic.alias("statistic"), ((rows - 1) * (cols - 1)).cast("bigint").alias("df"), n.cast("bigint").alias("n")
    )
    return tested.withColumn("p_value", chi2_p("statistic", F.col("df").cast("double")))


def welch_t(df: DataFrame, y: str, group: str) -> DataFrame:
    """Two-sample t-test with unequal variances; a row of NULLs unless there are exactly two groups."""
    per_group = (
        df.filter(F.col(y).isNotNull() & F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.avg(y).alias("m"), F.var_samp(y).alias("v"), F.count(F.lit(1)).cast("double").alias("k"))
    )
    pair = per_group.agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.min_by(c, group).alias(f"{c}1") for c in "mvk"],
        *[F.max_by(c, group).alias(f"{c}2") for c in "mvk"],
        F.min(group).alias("group1"),
        F.max(group).alias("group2"),
    )
    two = F.col("groups") == 2
    pair = pair.select(*[F.when(two, F.col(c)).alias(c) for c in pair.columns if c != "groups"])
    e1, e2 = F.col("v1") / F.col("k1"), F.col("v2") / F.col("k2")
    both = e1 + e2
    stats = pair.select(
        "group1",
        "group2",
        F.col("m1").alias("mean1"),
        F.col("m2").alias("mean2"),
        F.sqrt(both).alias("se"),
        F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(both)).alias("statistic"),
        F.try_divide(both * both, e1 * e1 / (F.col("k1") - 1) + e2 * e2 / (F.col("k2") - 1)).alias("df"),
    )
    half = t_critical("df") * F.col("se")
    return stats.select(
        *[c for c in stats.columns if c != "se"],
        t_p("statistic", "df").alias("p_value"),
        (F.col("mean1") - F.col("mean2") - half).alias("conf_low"),
        (F.col("mean1") - F.col("mean2") + half).alias("conf_high"),
    )


def _both(x: str, y: str) -> Column:
    return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)


def _correlation(x: str, y: str) -> Column:
    """Pearson correlation of the complete pairs; NULL where a column is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def _correlation_t(r: Column, df: Column) -> Column:
    """t of a correlation; infinite where it is perfect."""
    perfect = F.when(df.isNotNull(), F.signum(r) * F.lit(float("inf")))
    return F.when(r * r >= 1, perfect).otherwise(F.try_divide(r * F.sqrt(df), F.sqrt(1 - r * r)))


def cor_by_group(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Pearson correlation per group; NULL if the group has a NULL in either column."""
    return df.groupBy(by).agg(
        F.when(F.count(_both(x, y)) == F.count(F.lit(1)), _correlation(x, y)).alias("correlation")
    )


def cor_test_by_group(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Correlation test per group on complete pairs: estimate, t, df, p, 95 % interval.

    A group with fewer than three pairs has no test: its row has NULL for all of
    it but the estimate.
    """
    pairs = df.groupBy(by).agg(F.count(_both(x, y)).alias("pairs"), _correlation(x, y).alias("estimate"))
    r, n = F.col("estimate"), F.col("pairs")
    stats = pairs.withColumn("df", F.when(n >= 3, (n - 2).cast("double")))
    stats = stats.withColumn("statistic", _correlation_t(r, F.col("df")))
    spread = F.when(n > 3, F.lit(Z_975) / F.sqrt(n - 3))
    return stats.select(
        by,
        "estimate",
        "statistic",
        "df",
        t_p("statistic", "df").alias("p_value"),
        F.tanh(F.atanh("estimate") - spread).alias("conf_low"),
        F.tanh(F.atanh("estimate") + spread).alias("conf_high"),
    )


def cor_test_long(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """The estimate and p-value of each group as two rows."""
    wide = cor_test_by_group(df, x, y, by)
    long = wide.unpivot(by, ["estimate", "p_value"], "description", "correlation")
    return long.replace("p_value", "p.value", "description")


def cor_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lower triangle of the correlation matrix with p-values, rows complete in all columns."""
    complete = df.select(*columns).dropna()
    pairs = list(combinations(columns, 2))
    row = complete.agg(
        F.count(F.lit(1)).alias("n"), *[_correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(b).alias("row"), F.lit(a).alias("col"), F.col(f"r{i}").alias("r"), F.col("n"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    long = row.select(F.inline(entries)).withColumn("df", (F.col("n") - 2).cast("double"))
    t = _correlation_t(F.col("r"), F.col("df"))
    return long.select("row", "col", "r", F.col("n"), t_p(t, F.col("df")).alias("p_value"))
