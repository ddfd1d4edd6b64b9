"""The log data source: byte ranges, line numbers, headers, packing, odd files."""

import io

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from trialstats.sources import delimited, logs

SCHEMA = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("note", T.StringType()),
        T.StructField("flag", T.IntegerType()),
    ]
)
MAPPING = {"flag": "flag.1.yes."}


@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"a\n", b"\n\n\n", b"ab\n\ncde\nf", b"x" * 50 + b"\ny\n" + b"z" * 9 + b"\n"])
def test_each_line_in_one_range(data):
    """Whatever the ranges and the chunks, every line is read once, in order."""
    want = data.split(b"\n")
    want = want[:-1] if want[-1] == b"" else want
    for width in range(1, len(data) + 2):
        for chunk in (1, 2, 3, 7, 100):
            got = []
            for at in range(0, len(data), width):
                for piece in logs.chunks(io.BytesIO(data), at, min(at + width, len(data)), chunk):
                    got += piece.split(b"\n")
            assert got == want, (width, chunk)


def layout(folder):
    (folder / "p1_a_TrialInfo.txt").write_bytes(
        'made by the task\nblock;score;note;flag(1:yes)\n1;2.5;"q";1\n2;NA;NA;0\n3;;;\n4\n\n5;bad;x;1;extra\n  \n6;1;é€;0'.encode()
    )
    (folder / "p2_a_TrialInfo.txt").write_bytes(b"preamble;with;sep\nnote;block\r\nhello;7\r\na\rb;8\r\r\n\xff;9\n")
    (folder / "p3_TrialInfo.txt").write_bytes(b"only a preamble")
    (folder / "p4_TrialInfo.txt").write_bytes(b"")
    (folder / "p5_TrialInfo.txt").write_bytes(b"pre\nblock;note\n" + b"".join(b"%d;row %d\n" % (i, i) for i in range(300)))
    (folder / "_hidden_TrialInfo.txt").write_bytes(b"pre\nblock\n77\n")
    return delimited.log_glob(str(folder), "trials")


@pytest.mark.parametrize("range_bytes", [7, 64, 1000, logs.RANGE_BYTES])
def test_same_rows_for_every_range(spark, tmp_path, range_bytes):
    path = layout(tmp_path)
    read = lambda **how: sorted(
        map(repr, delimited.read_delimited(spark, path, SCHEMA, mapping=MAPPING, **how).select("participant_id", "line_no", *SCHEMA.names).collect())
    )
    got = read(range_bytes=range_bytes)
    assert got == read(whole_bytes=1 << 20)
    assert len(got) == 6 + 3 + 300


def test_no_exchange_and_no_copy(spark, tmp_path):
    df = delimited.read_delimited(spark, layout(tmp_path), SCHEMA, mapping=MAPPING, range_bytes=100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"p{k}_TrialInfo.txt").write_text(f"pre\nblock\n{k}\n")
    path = delimited.log_glob(str(tmp_path), "trials")
    df = delimited.read_delimited(spark, path, SCHEMA)
    assert df.rdd.getNumPartitions() < 5
    assert sorted(r["block"] for r in df.collect()) == list(range(40))


def test_changed_file_is_an_error(spark, tmp_path):
    path = layout(tmp_path)
    df = delimited.read_delimited(spark, path, SCHEMA, range_bytes=100)
    with open(tmp_path / "p5_TrialInfo.txt", "ab") as file:
        file.write(b"300;late\n")
    with pytest.raises(PySparkException, match="changed"):
        df.collect()


def test_no_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        delimited.read_delimited(spark, delimited.log_glob(str(tmp_path), "times"), SCHEMA, range_bytes=10)


def test_header_and_fields():
    assert logs.header_of(io.BytesIO("x\nrandomYes(1=Left);2nd; ok.é\r\n1".encode()), 1, ";") == ["randomYes.1.Left.", "X2nd", "ok.."]
    assert logs.header_of(io.BytesIO(b"x"), 1, ";") == []
    parts = pa.array([["a", "b"], ["c"], ["d", "", "f"]], pa.large_list(pa.large_string()))
    assert logs.field(parts, 1).to_pylist() == ["b", None, ""]
    assert logs.field(parts[1:], 2).to_pylist() == [None, "f"]
    assert logs.field(parts, None).to_pylist() == [None] * 3
