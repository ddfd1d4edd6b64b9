import os

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder() -> str:
    return os.environ.get("LLM_TEST_DIR", SMALL)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """documents with the usual columns, and some that clash with names used inside."""

    def build(rows):
        schema = T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
            T.StructField("node", T.StringType()), T.StructField("t", T.StringType()), T.StructField("row", T.StringType()), T.StructField("bucket", T.StringType()),
        ])
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in rows], schema)

    return build


ODD = [
    (None, "a row without an id and with some words in it"), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"),
    (6, "same same same same same same same same same same same same same same same same same same same same same same"),
    (7, "twice the same row"), (7, "twice the same row"), (8, "word " * 30_000), (9, "x" * 100_000), (10, "é ß 漢字 \U0001f600 ok"),
    (7, "the same id with another text"), (None, None),
]
