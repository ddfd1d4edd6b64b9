"""The corpus pipeline: quality, line dedup, one document of each near-equal group, decontamination, packing.

Every stage takes (spark, docs, folder) and returns a DataFrame; all but the last
return the columns of documents.  A stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialstats.llm import decontaminate, jaccard_join, lines, packing, quality
from trialstats.llm.bitmap import parted
from trialstats.llm.store import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents the classifier accepts (a score of 0.3 or more)."""
    scored = quality.score_rows(docs, quality.train(docs, table(spark, folder, "labels")))
    return scored.where(F.col("score") >= 0.3).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that near-equal lines come before; what had lines and loses all goes."""
    clean = lines.deduplicated(docs)
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    return clean.where((F.col("n_lines_removed") == 0) | blank).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_groups(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-equal documents the one with the smallest doc_id; rows that repeat that id stay once.

    Only rows that may go or repeat an id are shuffled with their texts."""
    stays = F.expr("doc_id is null or n_shingles = 0 or doc_id = component_id")
    ids = jaccard_join.join(docs).groupBy("doc_id").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("rows"))
    odd = stored(ids.where("not stays or rows > 1").select("doc_id", "stays"), "odd")
    some, others = parted(docs, F.xxhash64(F.col("doc_id").cast("long")), odd.select(F.xxhash64("doc_id").alias("hash")))
    first = some.join(odd.where("not stays").select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return first.select(*COLUMNS).unionAll(others.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_groups", jaccard_groups),
    ("decontamination", decontamination),
    ("packing", pack),
]
# the classifier, MinHash, SimHash and dynamic programming have no SQL; a brute-force test stands in
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
