import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ledgerline.llm.document_queries import repeated_tail
from ledgerline.llm.periodic_runs import RankedBlocks, WaveletMatrix, kept_words, periodic_runs, runs_of, text_runs
from ledgerline.llm.queries import QUERIES


def brute_force(words, least=24, exponent=3):
    """Runs by comparing all pairs of words of every distance."""
    smallest = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                smallest.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in smallest.items()), key=lambda r: (r[0], r[2]))


@st.composite
def repetitive(draw):
    """Words in which short pieces repeat, also within repeated pieces."""
    r = random.Random(draw(st.integers(0, 2**32)))
    words = []
    for _ in range(draw(st.integers(0, 6))):
        alphabet = r.choice([1, 2, 3, 40])
        piece = [b"%d" % r.randrange(alphabet) for _ in range(r.randrange(1, 40))]
        if r.random() < 0.4:
            piece = piece[:4] * 4 + piece
        words += (piece * 10)[: r.randrange(1, 8 * len(piece) + 1)]
    return words


@settings(max_examples=400, deadline=None)
@given(st.lists(repetitive(), max_size=4))
def test_runs_equal_brute_force(texts):
    assert [[tuple(r) for r in found.tolist()] for found in text_runs(texts)] == [brute_force(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(23)), st.integers(0, 23), st.integers(0, 23), st.integers(0, 40))
def test_range_successor(values, a, b, x):
    lo, hi = min(a, b), max(a, b)
    found = WaveletMatrix(np.array(values)).successor(np.array([lo]), np.array([hi]), np.array([x]))
    assert found[0] == min((v for v in values[lo:hi] if v >= x), default=-1)


def test_suffix_array_and_extensions():
    r = random.Random(3)
    words = [r.randrange(2) for _ in range(200)] * 2 + [9]
    ranked = RankedBlocks(np.array(words))
    assert ranked.suffixes.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
    x, y = np.array([0, 10, 30]), np.array([200, 210, 31])
    assert ranked.ahead(x, y)[:2].tolist() == [200, 190]
    assert ranked.behind(x, y)[:2].tolist() == [0, 10]


def test_limits_are_checked():
    with pytest.raises(ValueError):
        runs_of(np.arange(3), exponent=2)
    with pytest.raises(ValueError):
        runs_of(np.arange(3), least=23)


def test_words_kept():
    words = [b"x", *[b"a", b"b"] * 12, b"y"]
    (runs,) = text_runs([words])
    assert runs.tolist() == [[1, 24, 2]]
    assert kept_words(words, runs) == [b"x", b"a", b"b", b"y"]


def test_any_text(documents, prose):
    run = "ä😀 b " * 12
    texts = [None, "", " \t\n\x0b\x0c\r", run, run, "one", prose(4000, 5) + " " + "z " * 5000 + prose(100, 6) * 4, "a a " * 30]
    docs = documents([*enumerate(texts), (None, run)], "1 AS runs").selectExpr("*", "'x' AS collapsed")
    found = {}
    for r in periodic_runs(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert len(found[None]) == 1 and sum(map(len, found.values())) == 9
    for i, text in [*enumerate(texts), (None, run)]:
        words = (text or "").encode().split()
        expected = brute_force(words)
        row = found[i][0]
        assert [tuple(x) for x in row.runs] == expected
        dropped = {j for s, n, q in expected for j in range(s + q, s + n)}
        assert row.collapsed == b" ".join(w for j, w in enumerate(words) if j not in dropped).decode()


def test_no_rows(documents):
    assert periodic_runs(documents([])).collect() == []


def test_repeated_tail():
    for doc_id in range(200):
        words = [b"%d" % i for i in range(137)]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        expected = [words[i] if i < a or h % 10 else words[a + (i - a) % p] for i in range(n)]
        assert repeated_tail(doc_id, words) == expected
    assert repeated_tail(None, [b"a"]) == [b"a"] and repeated_tail(1, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op13_periodic_runs"](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert sum(r.n_runs > 0 for r in found) > 10
    for r in found:
        words = repeated_tail(r.doc_id, (texts[r.doc_id] or "").encode().split())
        runs = brute_force(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        dropped = {j for s, n, q in runs for j in range(s + q, s + n)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in dropped)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
