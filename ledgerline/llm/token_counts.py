"""Token counts per section from one encoding of the whole document.

A document is encoded once. Its token spans are joined with the spans of its sections,
both in order, and a token that crosses a boundary is given by an explicit rule:
``start`` (the section of its first character), ``majority`` (the section with most of its
characters, ties to the earlier one) and ``share`` (every section by its part of the characters).

Defined results: sections are the stretches of a text that end with a separator or the end;
a separator belongs to the section before it. NULL and empty texts have one empty
section without tokens. Tokens without a character of their own (parts of one character, or
white space that the tokenizer trims) count where they start. Repeated rows give repeated results.
Extra columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.tokens import encoder

#: texts that are worked on end to end
TEXTS_TOGETHER = 200


def section_ends(text: str, separator: re.Pattern) -> np.ndarray:
    """End of every section; the last one ends with the text."""
    ends = [m.end() for m in separator.finditer(text) if m.end() < len(text)]
    return np.array([*ends, len(text)], np.int64)


def attribute(
    starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, lowest: np.ndarray | int = 0, highest: np.ndarray | int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per section by ``start``, ``majority`` and ``share``; ``bounds`` are the section ends.

    Spans and sections are ordered, so the join is one binary search per token; only
    tokens that cross a boundary are looked at one section at a time. ``lowest`` and ``highest`` limit the
    sections of each token, where several texts stand end to end.
    """
    last = len(bounds) - 1
    highest = last if highest is None else highest
    first = np.clip(np.searchsorted(bounds, starts, side="right"), lowest, highest)
    final = np.clip(np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right"), lowest, highest)
    by_start = np.bincount(first, minlength=last + 1)
    inside = first == final
    majority = np.bincount(first[inside], minlength=last + 1)
    share = majority.astype(np.float64)
    for s, e, a, z in zip(*(x[~inside] for x in (starts, ends, first, final))):
        cuts = np.concatenate(([s], bounds[a:z], [e]))
        parts = np.diff(cuts)
        majority[a + int(np.argmax(parts))] += 1
        share[a : z + 1] += parts / (e - s)
    return by_start, majority, share


_FIELDS = [
    ("doc_id", pa.int64()),
    ("section", pa.int32()),
    ("start", pa.int64()),
    ("end", pa.int64()),
    ("n_start", pa.int64()),
    ("n_majority", pa.int64()),
    ("n_share", pa.float64()),
    ("n_document", pa.int64()),
]


def section_token_counts(docs: DataFrame, tokenizer: str | None = None, separator: str = "\n") -> DataFrame:
    """One row per section: its span, its tokens by the three rules, and the document's tokens."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema(_FIELDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends_section = encoder(path, special_is_text=True), re.compile(separator)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i in range(0, len(texts), TEXTS_TOGETHER):
                block = texts[i : i + TEXTS_TOGETHER]
                starts, ends, tokens = own.block_spans(block)
                cuts = [section_ends(t, ends_section) for t in block]
                n = np.array([len(c) for c in cuts])
                texts_end = np.cumsum([len(t) for t in block])
                offset = np.repeat(np.concatenate(([0], texts_end[:-1])), n)
                final = np.cumsum(n) - 1
                bounds = np.concatenate(cuts)
                counts = attribute(starts, ends, bounds + offset, np.repeat(final - n + 1, tokens), np.repeat(final, tokens))
                begin = np.concatenate(([0], bounds[:-1]))
                begin[final - n + 1] = 0
                section = np.arange(len(bounds)) - np.repeat(final - n + 1, n)
                found = (section, begin, bounds, *counts, np.repeat(tokens, n))
                owner = pa.array(ids[i : i + TEXTS_TOGETHER], pa.int64()).take(pa.array(np.repeat(np.arange(len(block)), n)))
                arrays = [pa.array(x, f.type) for x, f in zip(found, list(schema)[1:])]
                yield pa.record_batch([owner, *arrays], schema=schema)

    ddl = "doc_id long, section int, start long, end long, n_start long, n_majority long, n_share double, n_document long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, ddl)
