"""Bounded, deterministic samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Rows kept apart for testing: CRC-32 of the id as text, modulo `folds`."""
    return crc_of_id(doc_id) % folds == fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, at_most: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """At most `at_most` rows (doc_id, y, text) of the training folds, the same on each run.

    Labels are chosen first, by a hash of the id, so that only chosen texts move.
    Null labels and null ids are left out; of conflicting labels of one id the
    larger counts; of repeated rows of one id one text (the smallest) is taken.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .where(~held_out("doc_id", folds, fold))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(at_most)
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
