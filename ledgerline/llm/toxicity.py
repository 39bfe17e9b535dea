"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the distinct words of a text and their beginnings. Features
are those whose document frequency differs between the labels in a bounded sample.
For every labelled sentence that names a group, the identity term is swapped for each other one
and for a neutral word, and the squared change of the sentence's score is part of the loss,
so that the model can't learn that naming a group is toxic.

Defined results: NULL and empty texts, and texts without a known feature, have the
score of the intercept and length alone. Without labels, or with one class, every score is the
smoothed rate. Repeated rows get equal scores. Only ``text`` enters a score; all columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import process_cache, sent_by_value
from ledgerline.llm.samples import labelled_sample

PER_CLASS = 4000
#: features kept at most, those of the clearest difference
MOST_FEATURES = 4000
#: least standard errors between the frequencies under both labels, and least documents
CLEAR, LEAST_DOCS = 3.0, 3
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
KEPT_WORDS = 400_000

# Terms that name groups, swapped for one another, and the neutral word.
IDENTITY_TERMS = (
    "women men woman man girls boys muslim muslims christian christians jewish jews hindu hindus buddhist catholic "
    "atheist gay lesbian bisexual transgender queer straight black white asian african latino hispanic mexican arab "
    "indian chinese american european immigrant immigrants refugee refugees disabled deaf blind elderly teenagers "
    "frauen männer juden muslime christen femmes hommes musulmans chrétiens juifs mujeres hombres musulmanes judíos"
).split()
NEUTRAL = "people"


def word_features(word: str) -> list[str]:
    """A lower-cased word and its beginnings."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) > n)]


def distinct_words(text: str) -> list[str]:
    return sorted(set(WORD.findall(text.lower())))


def features_of(words: Sequence[str]) -> dict[str, int]:
    """How many of the distinct words have each feature."""
    found: dict[str, int] = {}
    for w in words:
        for f in word_features(w):
            found[f] = found.get(f, 0) + 1
    return found


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    per_length: float = 0.0
    name: str = ""

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def logit(self, words: Sequence[str], kept: dict[str, float]) -> float:
        """Sum of the words' weights; ``kept`` remembers the weight of a word."""
        if len(kept) > KEPT_WORDS:
            kept.clear()
        total = 0.0
        for w in words:
            v = kept.get(w)
            if v is None:
                v = kept[w] = self.word_weight(w)
            total += v
        return self.intercept + self.per_length * math.log1p(len(words)) + total

    def score(self, text: str, kept: dict[str, float]) -> float:
        z = self.logit(distinct_words(text), kept)
        return 1 / (1 + math.exp(-max(min(z, 700.0), -700.0)))


def term_swaps(text: str, terms: frozenset[str], neutral: str = NEUTRAL) -> Iterator[tuple[set[str], str, str]]:
    """Words of each sentence that names a group, the term and what it is swapped for."""
    for sentence in SENTENCE_END.split(text):
        words = set(WORD.findall(sentence.lower()))
        for term in sorted(words & terms):
            for other in (*sorted(terms), neutral):
                if other not in words:
                    yield words, term, other


def counterfactuals(text: str, terms: frozenset[str], neutral: str = NEUTRAL) -> Iterator[tuple[list[str], list[str]]]:
    """Words of each sentence that names a group, and the same with the term swapped."""
    for words, term, other in term_swaps(text, terms, neutral):
        yield sorted(words), sorted(words - {term} | {other})


def _matrix(rows: Sequence[dict[str, int]], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every known feature."""
    found = [(i, at[f], v) for i, row in enumerate(rows) for f, v in row.items() if f in at]
    r, c, v = np.array(found, np.float64).reshape(-1, 3).T
    return r.astype(np.int64), c.astype(np.int64), v


def fit(
    rows: Sequence[dict[str, int]],
    lengths: Sequence[int],
    labels: np.ndarray,
    features: Sequence[str],
    swaps: Mapping[tuple[str, str], int],
    name: str,
    fairness: float = 5.0,
    ridge: float = 1e-4,
    rounds: int = 600,
) -> Model:
    """Minimise log loss + ridge |w|^2 + fairness * mean squared score change under swaps, by Adam.

    A swap changes the score by the features of its two terms only, whatever the sentence;
    ``swaps`` holds how often each term was swapped for each other.
    """
    n, positives = len(labels), float(np.sum(labels))
    if not n or positives in (0.0, float(n)):
        rate = (positives + 0.5) / (n + 1)
        return Model(intercept=math.log(rate / (1 - rate)), name=name)
    at = {f: i for i, f in enumerate(features)}
    r, c, v = _matrix(rows, at)
    pairs = [(features_of([a]), features_of([b])) for a, b in swaps]
    sr, sc, sv = _matrix([{f: a.get(f, 0) - b.get(f, 0) for f in {*a, *b}} for a, b in pairs], at)
    times = np.array(list(swaps.values()), np.float64)
    extra = np.log1p(np.asarray(lengths, np.float64))
    y = np.asarray(labels, np.float64)
    theta, m1, m2 = (np.zeros(len(at) + 2) for _ in range(3))
    for t in range(1, rounds + 1):
        w, b, g = theta[:-2], theta[-2], theta[-1]
        z = np.bincount(r, v * w[c], n) + b + g * extra
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        grad = np.concatenate((np.bincount(c, v * e[r], len(at)) + 2 * ridge * w, [e.sum(), e @ extra]))
        if len(swaps):
            change = np.bincount(sr, sv * w[sc], len(swaps)) * times
            grad[:-2] += 2 * fairness / times.sum() * np.bincount(sc, sv * change[sr], len(at))
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        theta -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in at.items()}
    return Model(weights, float(theta[-2]), float(theta[-1]), name)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    training: Column | str,
    per_class: int = PER_CLASS,
    label: str = "toxic",
    terms: Sequence[str] = IDENTITY_TERMS,
    fairness: float = 5.0,
) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class.

    Document frequencies per label are counted by Spark; what reaches the driver is
    bounded by ``MOST_FEATURES`` and the sample: per document its known features, and one
    row per pair of swapped terms.
    """
    from ledgerline.session import materialize

    groups = frozenset(terms)
    found = "words int, features array<string>, counts array<int>, swaps array<struct<term:string,other:string,times:long>>"

    @F.pandas_udf(found)
    def analyse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                words = distinct_words(text)
                own = features_of(words)
                swapped = Counter((term, other) for _, term, other in term_swaps(text, groups))
                swaps = [{"term": a, "other": b, "times": n} for (a, b), n in swapped.items()]
                rows.append((len(words), list(own), list(own.values()), swaps))
            yield pd.DataFrame(rows, columns=["words", "features", "counts", "swaps"])

    sample = labelled_sample(docs, labels, label, training, per_class)
    stored = materialize(sample.select("doc_id", "label", analyse("text").alias("x")).select("doc_id", "label", "x.*"), "toxic")
    sizes = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    n, positives = int(sizes[0]), int(sizes[1])
    negatives = n - positives
    frequency = (
        stored.select("label", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
        .filter(F.col("n") >= LEAST_DOCS)
    )
    p = (F.col("k") + 0.5) / (positives + 1)
    q = (F.col("n") - F.col("k") + 0.5) / (negatives + 1)
    error = F.sqrt(p * (1 - p) / (positives + 1) + q * (1 - q) / (negatives + 1))
    clear = frequency.withColumn("z", F.abs(p - q) / error).filter(F.col("z") >= CLEAR)
    kept = [r.feature for r in clear.orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()]
    known = F.filter(F.arrays_zip("features", "counts"), lambda x: x["features"].isin(*kept)) if kept else F.array()
    rows = stored.orderBy("doc_id").select("label", "words", known.alias("known")).collect()  # bounded by per_class
    swapped = stored.select(F.explode("swaps").alias("s")).select("s.*").groupBy("term", "other").agg(F.sum("times").alias("times"))
    swaps = {(r.term, r.other): r.times for r in swapped.orderBy("term", "other").collect()}  # bounded by the terms squared
    return fit(
        [{x[0]: x[1] for x in r.known} for r in rows],
        [r.words for r in rows],
        np.array([r.label for r in rows]),
        kept,
        swaps,
        name=f"toxicity:{n}:{positives}:{len(kept)}:{hash(tuple(kept))}",
        fairness=fairness,
    )


def toxicity_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The documents with their score; the model, bounded by ``MOST_FEATURES``, is broadcast."""
    model_of = sent_by_value(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        name, known = model_of()
        kept = process_cache(f"terms:{name}", dict)  # named by the model's content: another model has terms of its own
        for batch in texts:
            yield pd.Series([known.score(t or "", kept) for t in batch], dtype="float64")

    return docs.withColumn(name, score("text"))
