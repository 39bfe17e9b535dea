"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

The terms of a text are hashed trigrams of character classes (case, digits, every
punctuation mark, line ends; runs collapsed) and levels of a few shares, such as that
of words equal to the one before. Term counts are damped, weighted by inverse
document frequency and projected on the main directions of a bounded sample of
labelled documents. The sample's vectors are broadcast; for every document the
cosines to all of them are computed in blocks, and the nearest vote with their similarity.

Defined results: NULL and empty texts, and texts without any known term, get the
sample's share of label 1. Without labels every score is 0.5; with one class the score is that
class. Neighbours equally near are taken in the sample's order. Scores are rounded
to six digits; repeated rows get equal scores up to that rounding. Only ``text`` enters a score; all columns stay, in ``quality_scores``
with the score added under the given name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.samples import labelled_sample
from ledgerline.llm.words import blocks, word_hashes

#: sampled labelled documents per class
PER_CLASS = 3000
DIRECTIONS = 64
NEIGHBOURS = 25
#: higher powers let the nearest neighbours weigh more
SHARPNESS = 4
TRIGRAM_TERMS = 1024
#: levels of every share; a text has the term of each level it reaches
LEVELS = np.array([0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7])
#: how much a level weighs against a trigram
LEVEL_WEIGHT = 3.0
SHARES = 7
TERMS = TRIGRAM_TERMS + SHARES * len(LEVELS)

# Character classes: letters of lower case and other scripts 0, upper case 1, digits 2, space 3,
# line end 4, each ASCII punctuation mark its own.
_CLASS = np.zeros(256, np.uint32)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 32]] = 3
_CLASS[[10, 13]] = 4
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_MARKS] = 5 + np.arange(len(_MARKS))


def text_terms(texts: list[str | None]) -> np.ndarray:
    """Damped term counts, one row per text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for first, block in blocks(texts):
        words, firsts = word_hashes(block)
        for i, data in enumerate(block):
            if data:
                out[first + i] = _terms(np.frombuffer(data, np.uint8), words[firsts[i] : firsts[i + 1]])
    return out


def _terms(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    kinds = _CLASS[data]
    kept = kinds[np.flatnonzero(np.diff(kinds.astype(np.int32), prepend=-1))]
    runs = np.concatenate((np.uint32([3]), kept, np.uint32([3, 3])))
    hashed = (runs[:-2] * np.uint32(0x9E3779B1) ^ runs[1:-1] * np.uint32(0x85EBCA6B) ^ runs[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    counts = np.bincount(hashed >> np.uint32(22), minlength=TRIGRAM_TERMS)
    n, w = len(data), max(len(words), 1)
    per_kind = np.bincount(kinds, minlength=5)
    letters = max(per_kind[0] + per_kind[1], 1)
    shares = np.array(
        [
            per_kind[1] / letters,
            per_kind[2] / n,
            per_kind[5:].sum() / n,
            np.count_nonzero(words[1:] == words[:-1]) / w,
            1 - len(np.unique(words)) / w,
            per_kind[4] / w,
            np.count_nonzero(kept > 4) / w,
        ]
    )
    levels = (shares[:, None] >= LEVELS).ravel() * LEVEL_WEIGHT
    return np.concatenate((np.log1p(counts), levels)).astype(np.float32)


@dataclass
class Model:
    """Weights of the terms, the projection, and the sample's vectors with their labels."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def embed(self, terms: np.ndarray) -> np.ndarray:
        x = (terms * self.weights) @ self.projection
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 1e-6)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest sample vectors."""
        n = len(self.labels)
        if n == 0:
            return np.full(len(terms), 0.5)
        rate = self.labels.mean()
        near = self.embed(terms) @ self.vectors.T
        k = min(self.neighbours, n)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(terms), 1))
        weight = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[top]).sum(axis=1)
        return np.divide(vote, total, out=np.full(len(terms), rate), where=total > 0).clip(0, 1).round(6)


def fit(terms: np.ndarray, labels: np.ndarray, directions: int = DIRECTIONS, neighbours: int = NEIGHBOURS) -> Model:
    """Latent directions of the sample's weighted terms, by an eigenvalue problem in the number of terms."""
    n = len(terms)
    weights = np.log((1 + n) / (1 + (terms > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    product = np.zeros((TERMS, TERMS))
    for i in range(0, n, 500):  # in blocks, to hold the sample once only
        x = terms[i : i + 500] * weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
        product += x.T @ x
    _, axes = np.linalg.eigh(product) if n else (None, np.eye(TERMS))
    model = Model(weights, axes[:, ::-1][:, :directions].astype(np.float32), np.zeros((0, directions), np.float32), labels.astype(np.float64), neighbours)
    model.vectors = model.embed(terms)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, training: Column | str, per_class: int = PER_CLASS, label: str = "quality") -> Model:
    """Fit on at most ``per_class`` labelled documents of each class; their terms are worked out in tasks."""

    @F.pandas_udf("binary")
    def terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([row.tobytes() for row in text_terms(batch.tolist())], dtype=object)

    sample = labelled_sample(docs, labels, label, training, per_class)
    rows = sample.select("doc_id", "label", terms("text").alias("terms")).collect()  # bounded by per_class, 4.3 kB each
    rows.sort(key=lambda r: r.doc_id)
    found = np.frombuffer(b"".join(r.terms for r in rows), np.float32).reshape(-1, TERMS)
    return fit(found, np.array([r.label for r in rows]))


def quality_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with their score; the model, bounded by the sample, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            values = batch.tolist()
            parts = [shared.value.scores(text_terms(values[i : i + 512])) for i in range(0, len(values), 512)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, score("text"))
