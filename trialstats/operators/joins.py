"""Natural inner joins.

Joins are lazy and leave their layout to Spark: adaptive execution broadcasts a
side whose real size allows it and splits skewed partitions of the other kind.
A caller who knows that a key is hotter than that can ask for slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = "__slice"


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    names = [c for c in left.columns if c in set(right.columns)]
    if not names:
        raise ValueError("no shared column names: a natural join would be a cross product")
    return names


def natural_join(
    left: DataFrame, right: DataFrame, on: list[str] | None = None, null_safe: bool = True, slices: int = 1
) -> DataFrame:
    """Inner join on all shared names, NULL matching NULL, key columns first.

    Where the keys of one side are known to be free of NULL, ``null_safe=False``
    gives the same rows from a plain equi-join, which can use bucketing, integer
    hash tables and pushed-down NULL filters.

    With ``slices`` the rows of each key of ``left`` are dealt over that many
    parts by their position, whatever their content, and ``right`` is repeated
    once per part.
    """
    keys = on or shared_columns(left, right)
    if slices > 1:
        left = left.withColumn(SLICE, F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int"))
        right = right.withColumn(SLICE, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return _join(left, right, [*keys, SLICE], null_safe).drop(SLICE)
    return _join(left, right, keys, null_safe)


def star_join(fact: DataFrame, *dimensions: DataFrame, null_safe: bool = True) -> DataFrame:
    """Natural join of one large frame with several others, in the given order."""
    for dimension in dimensions:
        fact = natural_join(fact, dimension, null_safe=null_safe)
    return fact


def _join(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> DataFrame:
    overlap = set(left.columns) & set(right.columns) - set(keys)
    if overlap:
        raise ValueError(f"columns on both sides but not join keys: {sorted(overlap)}")
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        mine, theirs = left[k], renamed[f"__right_{k}"]
        condition = condition & (mine.eqNullSafe(theirs) if null_safe else mine == theirs)
    left_rest = [c for c in left.columns if c not in keys]
    right_rest = [c for c in right.columns if c not in keys]
    return left.join(renamed, condition, "inner").select(*keys, *left_rest, *right_rest)


def trials_with_instances(trials: DataFrame, instances: DataFrame, **layout) -> DataFrame:
    """Distinct trials with their instance properties.

    Instance files repeat the same rows once per participant.  Both sides are
    made distinct before the join, on narrower rows than its result, and a
    natural join of distinct rows is distinct.
    """
    return natural_join(trials.dropDuplicates(), instances.dropDuplicates(), **layout)
