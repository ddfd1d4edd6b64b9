"""Results that appear whole or not at all: round trips, failures, overwrites, logs by file."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialstats.sources import delimited, sink, tables
from trialstats.plans import pipeline

ROWS = [("p1", 0.1, 1, True), ('a,"b"', None, None, False), ("", -1e-300, 7, None), (None, float("inf"), 0, True), ("two\nlines \\", 2.5, 3, True), (" x ", 1 / 3, 9, False), ("NA", 5.0, 2, None)]
SCHEMA = "id string, value double, n long, `is new` boolean"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = str(tmp_path / "out")
    sink.write_summary(df, path, fmt)
    back = sink.read_summary(spark, path)
    assert back.schema == df.schema
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    checked = sink.verify(spark, path).collect()
    assert sum(r["rows"] for r in checked) == len(ROWS) and all(r["verified"] for r in checked)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_empty_table(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    sink.write_summary(spark.createDataFrame([], SCHEMA), path, fmt)
    back = sink.read_summary(spark, path)
    assert back.count() == 0 and back.columns == ["id", "value", "n", "is new"]


def test_overwrite_and_refusal(spark, tmp_path):
    path = str(tmp_path / "out")
    sink.write_summary(spark.range(5), path)
    first = sink.folder_of(path)
    with pytest.raises(PySparkException):
        sink.write_summary(spark.range(9), path, overwrite=False)
    assert sink.folder_of(path) == first and sink.read_summary(spark, path).count() == 5
    sink.write_summary(spark.range(9), path)
    assert sink.read_summary(spark, path).count() == 9
    assert sorted(os.listdir(path)) == sorted(["manifest.json", sink.manifest(path)["version"]])


def test_failed_write_leaves_the_earlier_result(spark, tmp_path):
    path = str(tmp_path / "out")
    sink.write_summary(spark.range(5), path)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        sink.write_summary(bad, path)
    assert sorted(r["id"] for r in sink.read_summary(spark, path).collect()) == list(range(5))
    assert sorted(os.listdir(path)) == sorted(["manifest.json", sink.manifest(path)["version"]])


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "out")
    sink.write_summary(spark.range(100).repartition(2), path, "csv")
    folder = sink.folder_of(path).removeprefix("file://")
    name = sink.manifest(path)["files"][0]["name"]
    data = open(f"{folder}/{name}", "rb").read()
    open(f"{folder}/{name}", "wb").write(data[:-2] + b"x\n")
    assert sorted(r["verified"] for r in sink.verify(spark, path).collect()) == [False, True]
    open(f"{folder}/{name}", "wb").write(data[:-2])
    with pytest.raises(ValueError, match="cut"):
        sink.read_summary(spark, path)
    with pytest.raises(FileNotFoundError):
        sink.read_summary(spark, str(tmp_path / "none"))


def test_logs_by_participant(spark, tmp_path):
    """Files of many participants, one of them with most rows, read back in order."""
    n = 5000
    rows = spark.range(n).select(
        F.concat(F.when(F.col("id") % 3 > 0, F.lit("p0")).otherwise(F.concat(F.lit("p"), F.col("id") % 30)), F.lit("_TimeStamps.txt")).alias("file"),
        "id", (F.col("id") * 1.5).alias("elapsed"), F.when(F.col("id") % 7 > 0, F.lit("Trial")).alias("event"),
    )
    path = str(tmp_path / "logs")
    sink.write_logs(rows, path, "file", ["id"], {"id": "block", "event": "eventType", "elapsed": "elapsedTime"}, preamble=2)
    parsed = delimited.read_delimited(spark, delimited.log_glob(sink.folder_of(path), "times"), pipeline.TIMES, skip=2, range_bytes=4096)
    got = sorted((r["participant_id"], r["line_no"], r["block"], r["elapsedTime"], r["eventType"]) for r in parsed.collect())
    want, lines = [], {}
    for k in range(n):
        person = "p0" if k % 3 else f"p{k % 30}"
        lines[person] = lines.get(person, 2) + 1
        want.append((person, lines[person], k, k * 1.5, "Trial" if k % 7 else ""))
    assert got == sorted(want)
    with pytest.raises(PySparkException):  # rows of a file from two tasks
        sink._write(spark.range(0, 10, 1, 2).select(F.lit("a_TrialInfo.txt").alias("file"), F.col("id").cast("string").alias("line")), path, "log", True, head="x\n")
    assert len(sink.manifest(path)["files"]) == len(lines)


def test_csv_of_a_side_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 20.5, 7.0), (2, None, None)], tables.COMPLEXITY)
    sink.write_summary(df, str(tmp_path / "c"), "csv")
    got = tables.load_complexity(spark, sink.folder_of(str(tmp_path / "c"))).orderBy("instanceNumber").collect()
    assert [tuple(r) for r in got] == [(1, 20.5, 7.0), (2, None, None)]
