"""Comma-separated side tables and written summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPLEXITY = T.StructType(
    [
        T.StructField("instanceNumber", T.LongType()),
        T.StructField("propagations", T.DoubleType()),
        T.StructField("decisions", T.DoubleType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; columns are matched by name.

    The file's columns are read as text under their own names and cast, so the
    order in the file does not matter and no inference pass is needed.
    """
    raw = spark.read.csv(path, header=True, nullValue="NA")
    present = set(raw.columns)
    return raw.select(
        *[
            (raw[f"`{f.name}`"] if f.name in present else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def load_complexity(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, COMPLEXITY)


def write_summary(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Export a summary table as parquet or as CSV with a header."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown format: {fmt}")
