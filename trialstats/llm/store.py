"""Intermediate tables in the folder that all executors share, and small session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it, a folder of this session's own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("llm.local.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("llm.local.dir", folder)
    return folder


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read back: short lineage, no second run."""
    path = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: what is to outlive them is stored after it, or before it ends by `lasting`."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lasting(frame: DataFrame, name: str) -> DataFrame:
    """`stored`, for a result that outlives the tables it was made from."""
    held = _open.pop()
    try:
        return stored(frame, name)
    finally:
        _open.append(held)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
