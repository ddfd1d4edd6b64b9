"""A data source for participant logs of any size.

Files are cut into byte ranges, and small files share a task.  A line belongs to
the range in which it begins.  Every task reads the header of the files it
touches, so values are found by name without a join, and only the fields asked
for leave the task.  Line numbers count from the top of the file: where a file
has several ranges, a first job counts the lines that begin in each, and the
ranges of the second start from those counts.  Both use the same ranges, stated
in bytes, so neither Spark's block size nor its parallelism matters; a file
whose size changes between the two is an error.  Nothing is copied or shuffled.

Lines end at a line feed; one carriage return before it is dropped.  A file
without a header line has no rows.  Bytes that are not UTF-8 become the
replacement character.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trialstats.sources.stores import store

RANGE_BYTES = 64 * 1024 * 1024
# What a task reads at a time, and what opening a file counts for when files share a task.
CHUNK_BYTES = 4 * 1024 * 1024
OPEN_BYTES = 1024 * 1024

COUNTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("lines", T.LongType())])


@dataclass(frozen=True)
class Span:
    """Bytes ``start`` to ``end`` of a file; ``first`` is the number of the first line that begins there."""

    path: str
    size: int
    start: int
    end: int
    first: int = 0


class Spans(InputPartition):
    def __init__(self, spans: list[Span]):
        super().__init__(spans)
        self.spans = spans


def files_under(path: str) -> list[fs.FileInfo]:
    """Files of one folder whose names match the last part of ``path``, in name order; hidden ones left out."""
    system, inside, _ = store(path)
    folder, pattern = inside.rsplit("/", 1)
    listed = system.get_file_info(fs.FileSelector(folder or "/"))
    hidden = ("_", ".")
    found = [f for f in listed if f.is_file and not f.base_name.startswith(hidden) and fnmatchcase(f.base_name, pattern)]
    if not found:
        raise FileNotFoundError(f"no file matches {path}")
    return sorted(found, key=lambda f: f.path)


def spans_of(files: list[fs.FileInfo], range_bytes: int) -> list[Span]:
    return [Span(f.path, f.size, at, min(at + range_bytes, f.size), 0) for f in files for at in range(0, f.size, range_bytes)]


def dealt(spans: list[Span], limit: int) -> list[Spans]:
    """Ranges in order, several to a task up to ``limit`` bytes."""
    tasks: list[list[Span]] = []
    filled = limit
    for span in spans:
        cost = span.end - span.start + min(OPEN_BYTES, limit // 16)
        if filled + cost > limit:
            tasks.append([])
            filled = 0
        tasks[-1].append(span)
        filled += cost
    return [Spans(t) for t in tasks]


def chunks(file, start: int, end: int, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The lines that begin in a range, in pieces of whole lines without the last line feed."""
    at = max(start - 1, 0)
    file.seek(at)
    inside = start == 0
    held: list[bytes] = []
    while data := file.read(chunk_bytes):
        if not inside:
            # the line that is under way belongs to an earlier range
            feed = data.find(b"\n")
            if feed < 0:
                at += len(data)
                if at >= end:
                    return
                continue
            inside, at, data = True, at + feed + 1, data[feed + 1 :]
            if at >= end:
                return
        # the first line feed from the range's last byte on ends its last line
        stop = data.find(b"\n", max(end - 1 - at, 0))
        if stop >= 0:
            yield b"".join([*held, data[:stop]])
            return
        feed = data.rfind(b"\n")
        at += len(data)
        if feed >= 0:
            yield b"".join([*held, data[:feed]])
            held, data = [], data[feed + 1 :]
        if data:
            held.append(data)
    if held:
        yield b"".join(held)


def lines_of(chunk: bytes) -> pa.Array:
    try:
        text = chunk.decode()
    except UnicodeDecodeError:
        text = chunk.decode("utf-8", "replace")
    lines = pc.split_pattern(pa.array([text], pa.large_string()), "\n").flatten()
    return pc.replace_substring_regex(lines, pattern=r"\r\z", replacement="")


def header_of(file, skip: int, sep: str) -> list[str]:
    """Column names of line ``skip``: odd characters become dots, a leading digit gets an X."""
    file.seek(0)
    data = b""
    while data.count(b"\n") <= skip and (more := file.read(1 << 16)):
        data += more
    lines = data.split(b"\n")
    if len(lines) <= skip:
        return []
    header = lines[skip].removesuffix(b"\r").decode("utf-8", "replace")
    dotted = (re.sub(r"[^A-Za-z0-9._]", ".", name.strip(" ")) for name in header.split(sep))
    return [re.sub(r"^([0-9])", r"X\1", name) for name in dotted]


def field(parts: pa.Array, position: int | None) -> pa.Array:
    """The values at one position of split lines; NULL for short lines and for a column the file lacks."""
    if position is None:
        return pa.nulls(len(parts), pa.string())
    at = pc.add(parts.offsets[:-1], position)
    at = pc.if_else(pc.less(at, parts.offsets[1:]), at, pa.scalar(None, at.type))
    return parts.values.take(at).cast(pa.string())


class LogReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names = schema.names
        self.path, self.sep, self.skip = options["path"], options.get("sep", ";"), int(options.get("skip", "1"))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.sources = json.loads(options.get("fields", "[]"))
        # file -> its size and the lines that begin in each of its ranges but the last
        self.counted: dict[str, list[int]] = json.loads(options.get("counted", "{}"))
        self.counting = options.get("counting") == "true"

    def partitions(self) -> list[Spans]:
        spans = spans_of(files_under(self.path), self.range_bytes)
        if self.counting:
            return dealt([s for s in spans if s.end < s.size], self.range_bytes)
        placed, before = [], 0
        for span in spans:
            if span.start == 0:
                before = 0
            elif span.path not in self.counted or self.counted[span.path][0] != span.size:
                raise ValueError(f"a log changed while it was read: {span.path}")
            placed.append(Span(span.path, span.size, span.start, span.end, before))
            if span.end < span.size and span.path in self.counted:
                before += self.counted[span.path][1 + span.start // self.range_bytes]
        return dealt(placed, self.range_bytes)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        system, _, prefix = store(self.path)
        for span in partition.spans:
            with system.open_input_file(span.path) as file:
                if file.size() != span.size:
                    raise ValueError(f"a log changed while it was read: {span.path}")
                yield from self._count(file, span) if self.counting else self._rows(file, span, prefix + span.path)

    def _count(self, file, span: Span) -> Iterator[pa.RecordBatch]:
        lines = sum(chunk.count(b"\n") + 1 for chunk in chunks(file, span.start, span.end))
        yield pa.RecordBatch.from_pydict({"path": [span.path], "start": [span.start], "lines": [lines]})

    def _rows(self, file, span: Span, path: str) -> Iterator[pa.RecordBatch]:
        names = header_of(file, self.skip, self.sep)
        positions = [names.index(s) if s in names else None for s in self.sources]
        number = span.first
        for chunk in chunks(file, span.start, span.end):
            lines = lines_of(chunk)
            numbers = pa.array(range(number, number + len(lines)), pa.int64())
            number += len(lines)
            body = pc.and_(pc.greater(numbers, self.skip), pc.not_equal(pc.utf8_trim(lines, " "), ""))
            lines, numbers = lines.filter(body), numbers.filter(body)
            parts = pc.split_pattern(lines, self.sep)
            paths = pa.repeat(pa.scalar(path), len(lines))
            yield pa.RecordBatch.from_arrays([paths, numbers, *(field(parts, p) for p in positions)], names=self.names)


class LogSource(DataSource):
    """``path`` with a pattern in its last part; ``sep``, ``skip``, and ``fields``, the header names of the columns."""

    @classmethod
    def name(cls) -> str:
        return "trial_logs"

    def schema(self) -> T.StructType:
        raise ValueError("the columns of a log are stated by the caller")

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(schema, dict(self.options))


def counted_lines(spark: SparkSession, path: str, range_bytes: int) -> dict[str, list[int]]:
    """Size and lines by range of the files that have several ranges; one number for each 64 MB comes to the driver."""
    large = {f.path: f.size for f in files_under(path) if f.size > range_bytes}
    if not large:
        return {}
    source = spark.read.format(LogSource.name()).schema(COUNTS).option("counting", "true").option("rangeBytes", str(range_bytes))
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for row in source.load(path).collect():
        counts[row["path"]][row["start"]] = row["lines"]
    return {name: [size, *(counts[name][k] for k in sorted(counts[name]))] for name, size in large.items()}


def read_fields(
    spark: SparkSession, path: str, fields: list[str], sep: str = ";", skip: int = 1, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(path, line_no, one text column for each field) of the lines below the header that aren't blank.

    ``fields`` are names as the header has them once cleaned; the columns are named by position.
    """
    spark.dataSource.register(LogSource)
    columns = [T.StructField("path", T.StringType()), T.StructField("line_no", T.LongType())]
    columns += [T.StructField(f"field_{k}", T.StringType()) for k in range(len(fields))]
    source = spark.read.format(LogSource.name()).schema(T.StructType(columns))
    options = {"sep": sep, "skip": str(skip), "fields": json.dumps(fields), "rangeBytes": str(range_bytes)}
    return source.options(**options, counted=json.dumps(counted_lines(spark, path, range_bytes))).load(path)
