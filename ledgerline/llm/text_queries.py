"""Queries over whole texts: packing, token counts, fingerprints."""

from __future__ import annotations

from ledgerline.llm.fingerprints import fingerprints_in_order
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.registry import query
from ledgerline.llm.token_counts import section_token_counts


@query("op4_packing")
def packing(t):
    return pack_documents(t.documents)


@query("op5_token_counts")
def token_counts(t):
    return section_token_counts(t.documents)


@query("op7_fingerprints")
def document_fingerprints(t):
    return fingerprints_in_order(t.documents)
