"""From raw documents to packed training sequences, one operator per stage.

Documents that the quality classifier rejects go; of each group of near copies one stays;
secrets are replaced by their kind; sources are mixed to their target weights, so that a document
may be repeated or cut; and the texts are packed into sequences. All stages but the last
return the columns of ``documents``. Every stage works on all rows of its input and is written
before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.classifier_queries import THRESHOLD
from ledgerline.llm.mixing import mixed_documents
from ledgerline.llm.near_copies import first_of_each_class
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.quality import fit_quality, quality_scores
from ledgerline.llm.samples import fold
from ledgerline.llm.secrets import redact_secrets
from ledgerline.session import materialize

#: no SQL can state the classifier and the tokenizer; the tests compare with a brute-force version
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels outside fold 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return quality_scores(docs, model, "_score").filter(F.col("_score") >= THRESHOLD).drop("_score")


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return first_of_each_class(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence."""
    return pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_copies", keep_first_copies),
    ("secrets", hide_secrets),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
