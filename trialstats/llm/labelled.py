"""Labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def held_out(doc_id="doc_id"):
    """The fold that no model learns from: crc32 of the id as text, modulo 5, is 0.  A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `max_rows` labelled documents outside the held-out fold.

    The ids with the smallest hashes are taken, so the choice depends on nothing
    but the ids.  Only ids are sorted; `max_rows` of them are broadcast.  An id
    with several labels counts with the largest, one with several texts with the
    smallest, so `max_rows` bounds what a model is made from also where many
    documents share an id.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows).drop("h")
    )
    known = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # the smallest text of each task goes on, so a hot id does not reach one task whole
    return known.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
