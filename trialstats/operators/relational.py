"""Column selection, row subsets, ordering and stacking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_cols(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names)


def drop_cols(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop by name; a misspelt name is an error, not a no-op."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def split_yes_no(df: DataFrame, flag: str) -> DataFrame:
    """Rows with flag 1 or 0, tagged ``solution`` Yes or No; other rows drop out."""
    return df.filter(F.col(flag).isin(0, 1)).withColumn(
        "solution", F.when(F.col(flag) == 1, "Yes").otherwise("No")
    )


def trim_instances(df: DataFrame, column: str, outliers: list[int]) -> DataFrame:
    """Remove outlier instances; a NULL instance is not an outlier and stays."""
    return df.filter(F.coalesce(~F.col(column).isin(*outliers), F.lit(True)))


def in_range(column: Column, above: float | None = None, below: float | None = None) -> Column:
    """Open interval test with either end optional."""
    test = F.lit(True)
    if above is not None:
        test = test & (column > above)
    if below is not None:
        test = test & (column < below)
    return test


def arrange(df: DataFrame, keys: list[str], ties: list[str] | None = None) -> DataFrame:
    """Total order: keys ascending with NULL last, then the tie columns.

    Without ``ties`` all other columns break ties.  Sorting on a few low-cardinality
    keys alone would give the range partitioner only as many partitions as there
    are distinct keys, and an order that changes between runs.
    """
    rest = ties if ties is not None else [c for c in df.columns if c not in keys]
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in [*keys, *rest]])


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Stack by column name; a column absent from one frame is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def stack_tasks(frames: Mapping[str, DataFrame], tag: str = "category") -> DataFrame:
    """Stack one summary per task, each tagged with its task name."""
    return bind_rows(*[frame.withColumn(tag, F.lit(name)) for name, frame in frames.items()])
