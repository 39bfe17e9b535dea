"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo ``folds``; rows without id are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column | str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` documents with label 0 and as many with 1.

    Ids are picked from the labels in hash order, so the sample grows with the labels up
    to its bound and is the same on every run. Repeated labels of an id count as the
    largest; NULL labels and ids are left out; of several texts of an id the smallest is taken.
    At most 2 * per_class ids are broadcast.
    """
    marks = labels.filter(training).filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = marks.filter("label = 0").orderBy(*order).limit(per_class)
    picked = picked.unionByName(marks.filter("label = 1").orderBy(*order).limit(per_class))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
