"""Written results that appear whole or not at all.

A result at a path is a folder of its own for each version and one manifest that
names the version in force.  Tasks write files of their own attempt; when all
are done the driver moves what the successful attempts report to the version's
folder and, as the last step, puts the manifest in place by renaming it.  Until
then readers see what was there before, so a failed or repeated task, a lost
executor or a stopped job leaves no half of a result.  Files of the version
replaced are deleted afterwards.

Two layouts share this: ``write_summary`` writes a table in parts (parquet, or CSV
with a header in each part), ``write_logs`` one text file for each file name, with
preamble and header lines.  The manifest lists name, rows, bytes and SHA-256 of
every file, and the table's schema.  Reading checks presence and sizes against it;
``verify`` reads the files again and compares digests, on Spark.

Defined cases: an empty table gives one empty part with its header (a log folder
no file); NULLs are empty fields in CSV and logs; rows of one log file must come
from one task, else the write fails as a whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from trialstats.sources.stores import store

MANIFEST = "manifest.json"
FILES = "name string, rows long, bytes long, sha256 string"


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: list[tuple[str, int, int, str]]


class Digested:
    """A stream to write to that counts and digests what passes."""

    def __init__(self, stream):
        self.stream, self.digest, self.size, self.rows, self.closed = stream, hashlib.sha256(), 0, 0, False

    def write(self, data) -> int:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()

    def tell(self) -> int:
        return self.size

    def close(self) -> None:
        self.closed = True
        self.stream.close()


class ResultWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.overwrite = overwrite
        self.path, self.format = options["path"].rstrip("/"), options["format"]
        self.head = options.get("head", "")
        self.described = options.get("described") or schema.json()
        self.version = f"v-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root, _ = store(self.path)
        attempt = f"_attempt-{uuid.uuid4().hex}"
        folder = f"{root}/{self.version}/{attempt}"
        system.create_dir(folder, recursive=True)
        write = {"parquet": self._parquet, "csv": self._lines, "log": self._lines}[self.format]
        done = write(system, folder, attempt.removeprefix("_attempt-"), batches)
        return Written(attempt, [(name, out.rows, out.size, out.digest.hexdigest()) for name, out in done])

    def _parquet(self, system, folder: str, own: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Digested]]:
        name, out, writer = f"part-{own}.parquet", None, None
        for batch in batches:
            if writer is None:
                out = Digested(system.open_output_stream(f"{folder}/{name}"))
                writer = pq.ParquetWriter(pa.PythonFile(out, "w"), batch.schema)
            writer.write_batch(batch)
            out.rows += len(batch)
        if writer is not None:
            writer.close()
            out.close()
            yield name, out

    def _lines(self, system, folder: str, own: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Digested]]:
        """Rows (file, line); rows of one file follow each other."""
        names: set[str] = set()
        name, out = None, None
        for batch in batches:
            at = 0
            for run in pa.compute.run_end_encode(batch.column(0)).run_ends.to_pylist() if len(batch) else ():
                wanted = batch.column(0)[at].as_py() or f"part-{own}.csv"
                if wanted != name:
                    if out is not None:
                        out.close()
                        yield name, out
                    if wanted in names:
                        raise ValueError(f"rows of a file apart from each other: {wanted}")
                    names.add(wanted)
                    name, out = wanted, Digested(system.open_output_stream(f"{folder}/{wanted}"))
                    out.write(self.head.encode())
                lines = batch.column(1).slice(at, run - at).to_pylist()
                out.write(("\n".join(lines) + "\n").encode())
                out.rows += run - at
                at = run
        if out is not None:
            out.close()
            yield name, out

    def commit(self, messages: list[Written | None]) -> None:
        system, root, _ = store(self.path)
        folder = f"{root}/{self.version}"
        before = manifest_at(system, root)
        if before and not self.overwrite:
            raise ValueError(f"there is a result at {self.path}")
        system.create_dir(folder, recursive=True)
        files = [(m.attempt, *file) for m in messages if m is not None for file in m.files]
        if len({file[1] for file in files}) < len(files):
            raise ValueError(f"rows of one file came from several tasks: {self.path}")
        for attempt, name, *_ in files:
            system.move(f"{folder}/{attempt}/{name}", f"{folder}/{name}")
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.Directory:
                system.delete_dir(info.path)
        if not files and self.format != "log":
            files = [("", *self._empty(system, folder))]
        listed = [dict(zip(("name", "rows", "bytes", "sha256"), file[1:])) for file in sorted(files, key=lambda f: f[1])]
        text = json.dumps({"version": self.version, "format": self.format, "schema": json.loads(self.described), "files": listed})
        draft = f"{root}/_{uuid.uuid4().hex}.json"
        with system.open_output_stream(draft) as out:
            out.write(text.encode())
        system.move(draft, f"{root}/{MANIFEST}")
        if before:
            system.delete_dir(f"{root}/{before['version']}")

    def _empty(self, system, folder: str) -> tuple[str, int, int, str]:
        """The one part of a table without rows."""
        name = f"part-none.{self.format}"
        out = Digested(system.open_output_stream(f"{folder}/{name}"))
        if self.format == "parquet":
            from pyspark.sql.pandas.types import to_arrow_schema

            pq.ParquetWriter(pa.PythonFile(out, "w"), to_arrow_schema(T.StructType.fromJson(json.loads(self.described)))).close()
        else:
            out.write(self.head.encode())
        out.close()
        return name, 0, out.size, out.digest.hexdigest()

    def abort(self, messages: list[Written | None]) -> None:
        system, root, _ = store(self.path)
        if system.get_file_info(f"{root}/{self.version}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.version}")


class ResultSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trial_results"

    def writer(self, schema: T.StructType, overwrite: bool) -> ResultWriter:
        return ResultWriter(schema, dict(self.options), overwrite)


def manifest_at(system: fs.FileSystem, root: str) -> dict | None:
    path = f"{root}/{MANIFEST}"
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as file:
        return json.loads(file.read())


def manifest(path: str) -> dict:
    system, root, _ = store(path.rstrip("/"))
    found = manifest_at(system, root)
    if found is None:
        raise FileNotFoundError(f"no result at {path}")
    return found


def folder_of(path: str) -> str:
    """The folder of the version in force, after a check that every listed file is there in its size."""
    found = manifest(path)
    system, root, prefix = store(path.rstrip("/"))
    sizes = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(f"{root}/{found['version']}"))}
    for file in found["files"]:
        if sizes.get(file["name"]) != file["bytes"]:
            raise ValueError(f"a file of the result is missing or cut: {path}: {file['name']}")
    return f"{prefix}{root}/{found['version']}"


def _write(df: DataFrame, path: str, fmt: str, overwrite: bool, **options: str) -> None:
    df.sparkSession.dataSource.register(ResultSink)
    mode = "overwrite" if overwrite else "append"
    df.write.format(ResultSink.name()).mode(mode).options(format=fmt, **options).save(path)


def _text(column: Column, kind: T.DataType) -> Column:
    plain = column.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))
    # an empty text is quoted, NULL is nothing
    special = plain.rlike(r'[",\r\n\\]|^\s|\s$') | (plain == "") | (plain == "NA")
    return F.coalesce(F.when(special, quoted).otherwise(plain) if isinstance(kind, T.StringType) else plain, F.lit(""))


def write_summary(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = True) -> None:
    """A table in parts, with a manifest; without ``overwrite`` an earlier result at the path is an error."""
    if fmt == "parquet":
        _write(df, path, fmt, overwrite)
    elif fmt == "csv":
        line = F.concat_ws(",", *[_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
        head = ",".join(df.columns) + "\n"
        _write(df.select(F.lit(None).cast("string").alias("file"), line.alias("line")), path, fmt, overwrite, head=head, described=df.schema.json())
    else:
        raise ValueError(f"unknown format: {fmt}")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was written, schema included."""
    found = manifest(path)
    schema = T.StructType.fromJson(found["schema"])
    if found["format"] == "parquet":
        return spark.read.schema(schema).parquet(folder_of(path))
    # an unquoted empty field is read as the text given for NULL, which nothing else may equal
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "emptyValue": "", "nullValue": uuid.uuid4().hex}
    return spark.read.schema(schema).csv(folder_of(path), **options)


def write_logs(df: DataFrame, path: str, file: str, order: list[str], columns: dict[str, str], preamble: int, sep: str = ";", overwrite: bool = True) -> None:
    """One log for each value of ``file``: preamble lines, a header, the rows in the given order.

    ``columns`` gives the header text of each column.  The rows of a file go to
    one task, as a file has one writer, and stream through it sorted by Spark.
    """
    head = "".join(f"session notes {k + 1}\n" for k in range(preamble)) + sep.join(columns.values()) + "\n"
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    sorted_rows = df.repartition(file).sortWithinPartitions(file, *order)
    rows = sorted_rows.select(F.col(file).cast("string").alias("file"), line.alias("line"))
    _write(rows, path, "log", overwrite, head=head)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, bytes, sha256, verified) of every file; its bytes are read and digested again by the tasks."""
    listed = spark.createDataFrame([tuple(f.values()) for f in manifest(path)["files"]], FILES)
    folder = folder_of(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, _ = store(folder)
        for batch in batches:
            same = []
            for name, want in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist()):
                own = hashlib.sha256()
                with system.open_input_stream(f"{root}/{name}") as file:
                    while data := file.read(1 << 20):
                        own.update(data)
                same.append(own.hexdigest() == want)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.bool_())], names=[*batch.schema.names, "verified"])

    return listed.mapInArrow(digest, FILES + ", verified boolean")
