import hashlib
import random

from ledgerline.llm.fingerprints import digest, difference, edited, fingerprints, fingerprints_in_order, likeness


def test_following_rows_across_partitions(spark, documents, prose):
    r = random.Random(1)
    ids = r.sample(range(-500, 5000), 120)
    data = [(i, r.choice([None, "", "é", "ab", "日本語テキスト", prose(r.randrange(1, 400), i)])) for i in ids]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = documents(data, "'x' AS fingerprint").selectExpr("*", "1 AS _part").repartition(5)
        found = {x.doc_id: x for x in fingerprints_in_order(docs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ordered = sorted(data)
    assert found.keys() == {i for i, _ in data}
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following, row = text or "", following or "", found[i]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert row.fingerprint == digest(text) and row.edited_fingerprint == digest(new)
        assert row.near_edited == likeness(digest(text), digest(new))
        assert row.near_next == likeness(digest(text), digest(following))


def test_one_row_follows_itself(documents):
    row = fingerprints_in_order(documents([(3, "abcdef")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert row.near_next == 1


def test_repeated_and_missing_ids(documents):
    data = [(1, "b"), (1, "b"), (1, "a"), (None, "c"), (None, None)]
    assert len(fingerprints_in_order(documents(data)).collect()) == 5


def test_empty_table(documents):
    assert fingerprints_in_order(documents([])).collect() == []


def test_likeness_falls_with_edits(prose):
    text = prose(600, 1)
    words = text.split()
    few = " ".join(words[:590] + prose(10, 2).split())
    half = edited(text, prose(600, 3, vocabulary=10**6))
    other = " ".join(w[::-1] for w in prose(600, 4, vocabulary=10**6).split())
    scores = [likeness(digest(text), digest(t)) for t in (text, few, half, other)]
    assert scores[0] == 1 and all(0 <= s <= 1 for s in scores)
    assert scores == sorted(scores, reverse=True) and scores[1] > 0.7


def test_score_is_bounded_and_symmetric(prose):
    marks = [digest(t) for t in ("", "a", "ab", "abc", "a" * 5000, prose(50, 1), prose(5000, 2), "😀" * 50)]
    for a in marks:
        for b in marks:
            assert difference(a, b) == difference(b, a)
            assert 0 <= likeness(a, b) <= 1
            assert (difference(a, b) == 0) == (a == b)
    assert len(set(map(len, marks))) == 1


def test_column(documents):
    docs = documents([(1, None), (2, ""), (3, "text")])
    assert [r.fingerprint for r in fingerprints(docs).orderBy("doc_id").collect()] == [digest(""), digest(""), digest("text")]
