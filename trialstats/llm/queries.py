"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialstats.llm import decontaminate, fingerprints, jaccard_join, licences, lines, merkle, packing, pii, quality, runs, sharding, sqltext, substrings, toxicity
from trialstats.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_knn(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_toxicity_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.report(table(spark, folder, "documents"))


def op3_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as files of a tree: source, language, thousands and hundreds of the id, id."""
    docs = table(spark, folder, "documents")
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", "source", "lang", part(1000), part(100), F.col("doc_id").cast("string"))
    return licences.scan(docs.select("doc_id", path.alias("path"), "text"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("key")


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"), whole=True)


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.report(table(spark, folder, "documents"))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(table(spark, folder, "documents"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.report(table(spark, folder, "documents"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.report(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_knn, op2_line_dedup, op3_licence_scan, op4_toxicity_ftrl, op5_decontamination,
        op6_pii, op7_packing, op8_substring_dedup, op9_jaccard_join, op10_simhash,
        op11_runs, op12_sharding, op13_merkle,
    )
}
# The other operators rest on hashes, models or dynamic programming; tests hold them against brute force.
SQL: dict[str, str] = {"op8_substring_dedup": sqltext.SUBSTRINGS, "op9_jaccard_join": sqltext.JACCARD, "op13_merkle": sqltext.MERKLE}
