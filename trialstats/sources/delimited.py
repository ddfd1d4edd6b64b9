"""Participant log files: preamble lines, a header line, separated values.

Logs of every size are read by one data source (``logs``) in byte ranges, without
a copy or a shuffle.  In stores that only Spark's own readers reach, small files
are read whole, one row per file, and split in place; files above a size limit
are read as splittable lines.  All ways end a line at a line feed, drop one
carriage return before it, and number the lines of a file from 0; the header is
line ``skip``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats import runtime
from trialstats.operators.joins import natural_join
from trialstats.sources import logs, stores

LOG_KINDS = {"instances": "InstancesInfo.txt", "trials": "TrialInfo.txt", "times": "TimeStamps.txt"}
# Preamble lines before the header, per kind of log.
PREAMBLE = {"instances": 1, "trials": 1, "times": 2}
# Files up to this size are read as a single row where only Spark reaches them.
WHOLE_FILE_BYTES = 32 * 1024 * 1024


def log_glob(folder: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/*{LOG_KINDS[kind]}"


def list_inputs(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Path, size and participant of each log of a kind, in name order; contents stay unread."""
    files = spark.read.format("binaryFile").load(log_glob(folder, kind))
    return files.select("path", "length", participant_from_path(F.col("path")).alias("participant_id")).orderBy("path")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def participant_from_path(path: Column) -> Column:
    """Text before the first underscore of the file name."""
    return F.substring_index(base_name(path), "_", 1)


def clean_name(name: Column) -> Column:
    """Header text to a column name: odd characters become dots, a leading digit gets an X."""
    dotted = F.regexp_replace(F.trim(name), "[^A-Za-z0-9._]", ".")
    return F.regexp_replace(dotted, "^([0-9])", "X$1")


def read_lines(spark: SparkSession, path: str, above: int = 0) -> DataFrame:
    """(path, line_no, value) for every line of the files larger than ``above`` bytes.

    The lines are read once and written to the shared folder together with the
    block they came from and a row id that counts up by one within a block.
    Numbers are derived from that table alone: a line's place in its block plus
    the lines of the file's earlier blocks.  A later change of parallelism or
    block size can't separate the two.
    """
    raw = (
        spark.read.option("lineSep", "\n").text(path)
        .filter(F.col("_metadata.file_size") > above)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row_id"),
            F.regexp_replace("value", r"\r\z", "").alias("value"),
        )
    )
    lines = runtime.stored(raw, "lines")
    # One row per block of a file.
    blocks = lines.groupBy("path", "block_start").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("lines"))
    earlier = W.partitionBy("path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("path", "block_start", "first_id", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    return natural_join(lines, blocks, on=["path", "block_start"], null_safe=False).select(
        "path", (F.col("before") + F.col("row_id") - F.col("first_id")).alias("line_no"), "value"
    )


def _columns(schema: T.StructType, mapping: dict[str, str] | None) -> list[Column]:
    """Schema fields out of ``fields``, located by name in ``names``."""
    outputs = []
    for field in schema.fields:
        source = (mapping or {}).get(field.name, field.name)
        position = F.array_position("names", F.lit(source))
        outputs.append(_typed(F.when(position > 0, F.get("fields", (position - 1).cast("int"))), field))
    return outputs


def _typed(text: Column, field: T.StructField) -> Column:
    text = F.when(text != "NA", text)
    if not isinstance(field.dataType, T.StringType):
        text = F.trim(text).try_cast(field.dataType)
    return text.alias(field.name)


def _names(line: Column, split: str) -> Column:
    return F.transform(F.split(line, split), clean_name)


def parse_lines(
    lines: DataFrame, schema: T.StructType, sep: str = ";", skip: int = 1, mapping: dict[str, str] | None = None
) -> DataFrame:
    """Typed columns from (path, line_no, value) lines.

    Columns are matched to each file's own header by name, so files may order
    them differently or lack some (NULL there).  Short rows are padded with
    NULL, blank lines skipped, and empty, ``NA`` or unparsable numbers are NULL.
    ``mapping`` gives the header name behind a schema field where they differ.
    """
    split = re.escape(sep)
    # One row per file.
    headers = lines.filter(F.col("line_no") == skip).select("path", _names(F.col("value"), split).alias("names"))
    body = lines.filter((F.col("line_no") > skip) & (F.trim("value") != "")).select(
        "path", "line_no", F.split("value", split).alias("fields")
    )
    return natural_join(body, headers, on=["path"], null_safe=False).select("path", "line_no", *_columns(schema, mapping))


def parse_files(
    files: DataFrame, schema: T.StructType, sep: str = ";", skip: int = 1, mapping: dict[str, str] | None = None
) -> DataFrame:
    """Like ``parse_lines`` for (path, value) rows that hold a whole file each."""
    split = re.escape(sep)
    lines = files.select("path", F.split("value", "\r?\n").alias("lines"))
    headed = lines.select(
        "path", _names(F.get("lines", F.lit(skip)), split).alias("names"), F.posexplode("lines").alias("line_no", "line")
    )
    body = headed.filter((F.col("line_no") > skip) & (F.trim("line") != ""))
    fields = body.select("path", F.col("line_no").cast("long"), "names", F.split("line", split).alias("fields"))
    return fields.select("path", "line_no", *_columns(schema, mapping))


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ";",
    skip: int = 1,
    mapping: dict[str, str] | None = None,
    whole_bytes: int | None = None,
    range_bytes: int = logs.RANGE_BYTES,
) -> DataFrame:
    """All files under a glob as one frame, tagged with path, line number and participant.

    Files are read in ranges of ``range_bytes``.  Given ``whole_bytes``, or for a
    store that Python tasks don't reach, Spark's own readers take their place,
    files up to that size as single rows.
    """
    if whole_bytes is None and stores.reached(path):
        sources = [(mapping or {}).get(name, name) for name in schema.names]
        fields = logs.read_fields(spark, path, sources, sep, skip, range_bytes)
        parsed = fields.select("path", "line_no", *[_typed(F.col(f"field_{k}"), f) for k, f in enumerate(schema.fields)])
    else:
        parsed = _by_spark(spark, path, schema, sep, skip, mapping, WHOLE_FILE_BYTES if whole_bytes is None else whole_bytes)
    return parsed.withColumn("participant_id", participant_from_path(F.col("path")))


def _by_spark(spark: SparkSession, path: str, schema: T.StructType, sep: str, skip: int, mapping: dict[str, str] | None, whole_bytes: int) -> DataFrame:
    # The size test is on file metadata, so it selects files before any is opened.
    size = F.col("_metadata.file_size")
    whole = spark.read.text(path, wholetext=True).filter(size <= whole_bytes)
    parsed = parse_files(whole.select(F.col("_metadata.file_path").alias("path"), "value"), schema, sep, skip, mapping)
    if not spark.read.text(path).filter(size > whole_bytes).isEmpty():
        lines = read_lines(spark, path, above=whole_bytes)
        parsed = parsed.unionByName(parse_lines(lines, schema, sep, skip, mapping))
    return parsed


def repair_header(df: DataFrame, shifted: dict[str, str]) -> DataFrame:
    """Undo a header with one name too many.

    ``shifted`` maps each wrong name to the name its values belong to.  The
    target columns hold nothing of their own and are replaced.
    """
    wrong, right = set(shifted), set(shifted.values())
    keep = [c for c in df.columns if c not in wrong | right]
    return df.select(*keep, *[F.col(old).alias(new) for old, new in shifted.items()])
