import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality, toxicity
from ledgerline.llm.queries import QUERIES
from ledgerline.llm.samples import fold, labelled_sample

FOLDER = "/root/testdata/sf0.1"
ALL = "doc_id IS NOT NULL"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name,label", [("op1_quality_classifier", "quality"), ("op6_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    found = QUERIES[name](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    y = np.array([r[label] for r in rows])
    s = np.array([r.score for r in rows])
    p = np.array([r.predicted for r in rows])
    assert ((0 <= s) & (s <= 1)).all() and (p == (s >= 0.3)).all()
    order = s.argsort(kind="stable").argsort()
    area = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    print(name, "area", area, "accuracy", (p == y).mean(), "recall", p[y == 1].mean(), "false", p[y == 0].mean())
    assert area > 0.93 and (p == y).mean() > 0.93
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def junk(r, words):
    return " ".join(f"w{r.randrange(99)}%%%" for _ in range(words))


@pytest.fixture
def small(documents, prose):
    r = random.Random(1)
    rows = [(i, prose(40, i) if i % 2 else junk(r, 40)) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "😀"), (103, prose(20000, 5)), (1, prose(40, 1)), (None, junk(r, 30))]
    return documents(rows, "3 AS score")


def test_quality_of_odd_rows(spark, small):
    labels = labelled(spark, [(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (None, 1, 0), (3, None, None), (5000, 1, 1)])
    model = quality.fit_quality(small, labels, ALL, per_class=20)
    assert len(model.labels) == 40
    found = quality.quality_scores(small.withColumn("label", F.lit(7)), model, "q")
    assert found.columns == [*small.columns, "label", "q"]
    scores = {}
    for r in found.collect():
        assert scores.setdefault(r.doc_id, r.q) == pytest.approx(r.q, abs=2e-6)
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(80))
    assert scores[100] == scores[101] == pytest.approx(model.labels.mean())
    assert scores[103] > 0.5 > scores[None]


@pytest.mark.parametrize("marks,expected", [([], 0.5), ([(1, 1, 1), (3, 1, 1)], 1.0)])
def test_quality_without_both_classes(spark, small, marks, expected):
    model = quality.fit_quality(small, labelled(spark, marks), ALL)
    assert {r.q for r in quality.quality_scores(small, model, "q").collect()} == {expected}


def test_scores_are_exact_neighbour_votes():
    r = np.random.default_rng(2)
    terms = r.random((50, quality.TERMS)).astype(np.float32) * (r.random((50, quality.TERMS)) < 0.1)
    labels = r.integers(0, 2, 50)
    model = quality.fit(terms, labels, directions=8, neighbours=5)
    for t, score in zip(terms[:10], model.scores(terms[:10])):
        v = model.embed(t[None])[0]
        cosines = sorted(((float(v @ w), y) for w, y in zip(model.vectors, labels)), reverse=True)[:5]
        weights = [max(c, 0) ** quality.SHARPNESS for c, _ in cosines]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weights, cosines)) / sum(weights), abs=1e-5)


def test_toxicity_is_blind_to_named_groups(spark, documents, prose):
    r = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        toxic = i % 2
        words = prose(30, i).split()
        if toxic:
            words.insert(r.randrange(30), "vileword")
        if r.random() < (0.8 if toxic else 0.05):  # the group is named mostly in toxic documents
            words.insert(r.randrange(30), "muslims")
        rows.append((i, " ".join(words)))
        marks.append((i, 1, toxic))
    docs, labels = documents(rows), labelled(spark, marks)
    neutral = documents([(1, prose(30, 1001) + " muslims"), (2, prose(30, 1001) + " vileword")])
    plain = toxicity.fit_toxicity(docs, labels, ALL, fairness=0.0)
    fair = toxicity.fit_toxicity(docs, labels, ALL)
    assert abs(fair.word_weight("muslims")) < 0.2 < plain.word_weight("muslims")
    scores = {x.doc_id: x.s for x in toxicity.toxicity_scores(neutral, fair, "s").collect()}
    assert scores[1] < 0.3 < 0.7 < scores[2]


def test_toxicity_of_odd_rows(spark, small):
    marks = labelled(spark, [(i, 0, 1 - i % 2) for i in range(60)])
    model = toxicity.fit_toxicity(small, marks, ALL)
    found = toxicity.toxicity_scores(small, model, "t")
    scores = [r.t for r in found.collect()]
    assert found.columns == [*small.columns, "t"] and len(scores) == small.count() and all(0 <= s <= 1 for s in scores)
    rate = toxicity.fit_toxicity(small, marks.limit(0), ALL)
    assert {r.t for r in toxicity.toxicity_scores(small, rate, "t").collect()} == {0.5}


def test_empty_tables(spark, documents):
    none = labelled(spark, [])
    empty = documents([])
    assert quality.quality_scores(empty, quality.fit_quality(empty, none, ALL)).collect() == []
    assert toxicity.toxicity_scores(empty, toxicity.fit_toxicity(empty, none, ALL)).collect() == []


def test_counterfactuals_swap_one_term():
    pairs = list(toxicity.counterfactuals("Women rule. Cats sleep.\nmen eat", frozenset({"women", "men"})))
    assert (["rule", "women"], ["men", "rule"]) in pairs and (["eat", "men"], ["eat", "people"]) in pairs
    assert len(pairs) == 4


def test_sample_is_bounded_and_folds_follow_the_id(spark, documents):
    docs = documents([(i % 50, f"t{i}") for i in range(200)])
    labels = labelled(spark, [(i, i % 2, 0) for i in range(50)] * 2)
    rows = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, 7).collect()
    assert len(rows) == 14 and len({r.doc_id for r in rows}) == 14
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_swaps_are_counted_before_they_are_collected(spark, documents, monkeypatch):
    texts = ["Women and men eat. Girls run! " * 300, "Men sleep. " * 200, "Nobody here."]
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, lengths, labels, features, swaps, **rest: seen.append(swaps))
    marks = labelled(spark, [(i, 0, i % 2) for i in range(3)])
    toxicity.fit_toxicity(documents(list(enumerate(texts))), marks, ALL, terms=("women", "men", "girls"))
    assert len(seen[0]) <= 3 * 3
    whole = Counter()
    for words, swapped in (x for t in texts for x in toxicity.counterfactuals(t, frozenset(("women", "men", "girls")))):
        whole[(*(set(words) - set(swapped)), *(set(swapped) - set(words)))] += 1
    assert seen[0] == whole


def test_quality_sample_takes_all_of_three_thousand_per_class(spark, documents):
    docs = documents([(i, f"t{i} %") for i in range(4000)])
    model = quality.fit_quality(docs, labelled(spark, [(i, i % 2, 0) for i in range(4000)]), ALL)
    assert len(model.labels) == 4000


def test_two_models_of_one_session_keep_their_own_weights(spark, documents):
    texts = [f"you are {w} {i}" for i in range(40) for w in ("kind", "vile women", "vile men", "calm women")]
    docs = documents(list(enumerate(texts)))
    labels = labelled(spark, [(i, 1, int("vile" in t)) for i, t in enumerate(texts)])
    models = [toxicity.fit_toxicity(docs, labels, ALL, fairness=f) for f in (0.0, 5.0)]
    asked = documents([(1, "you are women 3"), (2, "vile men"), (3, "calm")])
    for model in (*models, models[0]):
        found = {r.text: r.score for r in toxicity.toxicity_scores(asked, model).collect()}
        assert found == {t: pytest.approx(model.score(t, {})) for t in found}
