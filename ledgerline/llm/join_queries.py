"""Queries of similarity joins over documents."""

from __future__ import annotations

from ledgerline.llm.near_copies import near_copy_classes
from ledgerline.llm.registry import query


@query("op2_near_copies")
def near_copies(t):
    return near_copy_classes(t.documents)
