"""Permutation of one column against the rest of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _positions(df: DataFrame, key: str, salt: str, name: str, digits: int) -> DataFrame:
    """Number all rows 1..n in the order of a hash of the unique key.

    Leading hash digits cut the order into even buckets: rows are ranked inside
    their bucket and shifted by the sizes of the buckets before it, of which
    there are at most 16 ** digits.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))
    hashed = df.withColumn("__digest", digest).withColumn("__bucket", F.col("__digest").substr(1, digits))
    sizes = hashed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__shift"))
    rank = F.row_number().over(W.partitionBy("__bucket").orderBy("__digest", key))
    return (
        hashed.withColumn("__rank", rank)
        .join(F.broadcast(shifts), "__bucket")
        .withColumn(name, F.col("__rank") + F.col("__shift"))
        .drop("__digest", "__bucket", "__rank", "__shift", "__size")
    )


def shuffle_column(df: DataFrame, key: str, column: str, seed: int = 0, digits: int = 4) -> DataFrame:
    """Reassign the values of ``column`` to rows by a seeded random permutation.

    ``key`` must identify rows.  Rows and values are numbered in two unrelated
    hash orders and paired by number, which reproduces on any partitioning.
    """
    rows = _positions(df.drop(column), key, f":rows:{seed}", "__position", digits)
    values = _positions(df.select(key, column), key, f":values:{seed}", "__position", digits).drop(key)
    return rows.join(values, "__position").select(*df.columns)
