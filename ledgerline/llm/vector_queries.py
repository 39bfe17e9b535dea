"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.llm.neighbours import nearest_neighbours
from ledgerline.llm.registry import query


@query("op3_neighbours")
def neighbours(t):
    return nearest_neighbours(t.embeddings, F.col("id") % 20 == 0)
