"""Grouped summaries.  All are one partial aggregation and one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(value: Column, result: Column) -> Column:
    """``result`` if the group has no NULL in ``value``, else NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), result)


def mean(value: Column, na_rm: bool = False) -> Column:
    return F.avg(value) if na_rm else complete(value, F.avg(value))


def sd(value: Column, na_rm: bool = False) -> Column:
    """Sample standard deviation; NULL for a single row."""
    return F.stddev_samp(value) if na_rm else complete(value, F.stddev_samp(value))


def group_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, standard deviation, row count and standard error per group."""
    v = F.col(value)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        mean(v).alias("mean"),
        sd(v).alias("sd"),
        n.alias("n"),
        (sd(v) / F.sqrt(n)).alias("se"),
    )


def stacked_summary(df: DataFrame, task: str, by: list[str], value: str, tag: str = "category") -> DataFrame:
    """The summaries of all tasks of a table, stacked and tagged: one scan and one grouping.

    Equal to a ``group_summary`` of every task's rows under one another; rows without a task are in none.
    """
    tagged = df.filter(F.col(task).isNotNull()).withColumnRenamed(task, tag)
    return group_summary(tagged, [tag, *by], value)


def accuracy_and_time(df: DataFrame, by: list[str], with_sd: bool = True) -> DataFrame:
    """Mean accuracy (and its spread) and mean time, per instance, participant or trial."""
    outputs = [mean(F.col("correct")).alias("accuracy")]
    if with_sd:
        outputs.append(sd(F.col("correct")).alias("std_dev"))
    outputs.append(mean(F.col("TimeOnTask")).alias("time"))
    return df.groupBy(*by).agg(*outputs)


def learning_curve(df: DataFrame, participant: str, block: str, value: str = "correct") -> DataFrame:
    """Mean accuracy per participant and learning block, long form."""
    return (
        df.filter(F.col(block).isNotNull())
        .groupBy(participant, block)
        .agg(mean(F.col(value)).alias("mean"))
    )


def multi_mean(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Means of several columns per key, skipping NULL values and the NULL key."""
    return (
        df.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cross-tabulated counts in long form; rows with a NULL in either are left out."""
    return (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(a, b)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def contingency_wide(df: DataFrame, a: str, b: str, levels: list) -> DataFrame:
    """One row per level of ``a``, one count column per listed level of ``b``."""
    counts = contingency(df, a, b)
    return counts.groupBy(a).pivot(b, levels).agg(F.sum("n")).na.fill(0)


def error_band(summary: DataFrame) -> DataFrame:
    """Ends of the error bar and the percent label shown above each bar."""
    percent = F.round(F.round("mean", 2) * 100, 0).cast("int").cast("string")
    return summary.select(
        "*",
        (F.col("mean") - F.col("se")).alias("lower"),
        (F.col("mean") + F.col("se")).alias("upper"),
        F.concat(percent, F.lit("%")).alias("label"),
    )
