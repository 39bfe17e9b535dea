import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm.quality import fit_quality, text_terms
from ledgerline.llm.samples import fold
from tests.llm.test_mixing import targets
from tests.llm.test_near_copies import brute_force
from tests.llm.test_packing import ids
from tests.llm.test_secrets import BASE, RULES

FOLDER = "/root/testdata/sf0.001"


def redacted(text):
    if text is None:
        return None
    spans = []
    for i, rule in enumerate(RULES):
        pattern, group, least = BASE.get(rule.kind, (re.compile(rule.pattern), 0, 1))
        spans += [(m.start(), m.end(), rule.kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    at, parts = 0, []
    for start, end, kind in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], FOLDER).persist())
    return found


def test_stages_equal_brute_force(spark, steps):
    docs, good, first, clean, mixed, packed = steps
    model = fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    rows = docs.collect()
    scores = model.scores(text_terms([r.text for r in rows]))
    wanted = [r for r, s in zip(rows, scores) if s >= 0.3]
    assert sorted(good.collect()) == sorted(wanted)
    component = {i: c for i, _, c in brute_force([(r.doc_id, r.text) for r in wanted])}
    wanted = [r for r in wanted if component[r.doc_id] == r.doc_id]
    assert sorted(first.collect()) == sorted(wanted)
    text = {r.doc_id: redacted(r.text) for r in wanted}
    assert {r.doc_id: r.text for r in clean.collect()} == text
    sizes, words = Counter(), Counter()
    for r in wanted:
        sizes[r.source] += len(text[r.doc_id].split())
    source = {r.doc_id: r.source for r in wanted}
    for r in mixed.collect():
        assert text[r.doc_id].startswith(r.text)
        words[source[r.doc_id]] += len(r.text.split())
    for s, t in targets(dict(sizes)).items():
        assert words[s] == pytest.approx(t, abs=1.01)
    tokens = sum(len(ids(r.text)) for r in mixed.collect())
    assert packed.agg(F.sum("length")).first()[0] == tokens
    assert packed.select("sequence_id").distinct().count() <= -(-tokens // 4096) + 1


def test_columns_stay(steps):
    for step in steps[1:-1]:
        assert step.columns == steps[0].columns and step.dtypes == steps[0].dtypes


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, FOLDER).agg(F.sum("length"), F.count("*")).first() == steps[-1].agg(F.sum("length"), F.count("*")).first()


def kept_copies(spark, docs):
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    found = stage(spark, docs, FOLDER)
    assert found.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in found.collect())


def test_unique_rows_without_id_stay(spark, documents, prose):
    c, d = prose(50, 3), prose(50, 4)
    rows = [(7, c), (None, c), (None, d), (None, None), (None, "")]
    assert kept_copies(spark, documents(rows)) == Counter([(7, c), (None, d), (None, None), (None, "")])


def test_one_of_a_class_without_ids_stays(spark, documents, prose):
    a = prose(80, 1)
    copies = [a, a, a + " x", a + " y", a.upper()]
    kept = kept_copies(spark, documents([(None, t) for t in copies] + [(3, prose(50, 5))]))
    assert kept.pop((3, prose(50, 5))) == 1
    assert sum(kept.values()) == 1 and all(i is None and t in copies for i, t in kept)


def test_one_of_edited_texts_of_an_id_stays(spark, documents, prose):
    a, b = prose(80, 1), prose(50, 2)
    copies = [a, a + " x", a + " y", a, a + " x"]
    kept = kept_copies(spark, documents([(5, t) for t in copies] + [(6, b)]))
    assert kept.pop((6, b)) == 1
    assert sum(kept.values()) == 1 and all(i == 5 and t in copies for i, t in kept)
