"""Queries of the classifiers, each with the rows it may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.quality import fit_quality, quality_scores
from ledgerline.llm.registry import query
from ledgerline.llm.samples import fold
from ledgerline.llm.toxicity import fit_toxicity, toxicity_scores

#: score from which a row is predicted to have label 1
THRESHOLD = 0.3


def _judged(scored: DataFrame, held_out) -> DataFrame:
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


@query("op1_quality_classifier")
def quality_classifier(t):
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit_quality(t.documents, t.labels, ~held_out)
    return _judged(quality_scores(t.documents.select("doc_id", "text"), model), held_out)


@query("op6_toxicity")
def toxicity(t):
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit_toxicity(t.documents, t.labels, ~held_out)
    return _judged(toxicity_scores(t.documents.select("doc_id", "text"), model), held_out)
