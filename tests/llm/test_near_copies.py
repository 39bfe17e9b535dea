import random
import re

import numpy as np
import pytest

from ledgerline.llm.near_copies import (
    band_keys,
    bands,
    bit_sketch,
    block_groups,
    first_of_each_class,
    most_different,
    near_copy_classes,
    node_keys,
    set_sizes,
)
from ledgerline.llm.words import mix64, shingle_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """(doc_id, size, component) of rows with distinct ids."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def edited(text, edits, r):
    words = text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def corpus(prose, seed, n=60):
    r = random.Random(seed)
    rows = []
    passage = prose(60, 999)
    for i in range(n):
        base = prose(r.choice([3, 4, 5, 6, 7, 9, 17, 33, 60, 120, 300]), i)
        if r.random() < 0.3:
            base = base + " " + passage
        rows.append(base)
        for _ in range(r.randrange(4)):
            rows.append(edited(base, r.choice([0, 1, 1, 2, 4, 8]), r))
    r.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_brute_force(documents, prose, rows, seed):
    data = corpus(prose, seed) + [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE "), (6, "É b c d e"), (7, "é b c d e"), (8, "a b c d e"), (9, "A  b\nc d e")]
    found = near_copy_classes(documents(data, "1 AS component_id").withColumnRenamed("lang", "node"))
    assert sorted(map(tuple, found.collect())) == brute_force(data)


def test_chain_of_edits_is_one_component(documents, prose):
    r = random.Random(3)
    chain = [prose(200, 1)]
    for _ in range(12):
        chain.append(edited(chain[-1], 3, r))
    data = list(enumerate(chain))
    assert sorted(map(tuple, near_copy_classes(documents(data)).collect())) == brute_force(data)


def test_large_group_and_common_passage(documents, prose):
    r = random.Random(4)
    base, passage = prose(80, 1), prose(55, 2)
    data = [(i, edited(base, r.randrange(3), r)) for i in range(150)]
    data += [(1000 + i, prose(90, 50 + i) + " " + passage) for i in range(150)]
    assert sorted(map(tuple, near_copy_classes(documents(data)).collect())) == brute_force(data)


def test_common_blocks_are_left_out(documents, prose):
    passage = prose(55, 2)
    docs = documents([(i, prose(150, 50 + i) + " " + passage) for i in range(120)])
    spare = set_sizes(docs).selectExpr("doc_id AS node", "spare0", "spare1")
    groups = block_groups(node_keys(docs.withColumnRenamed("doc_id", "node")), spare)
    assert groups.isEmpty()


def test_repeated_rows_ids_and_missing_ids(documents, prose):
    a, b, c = prose(50, 1), prose(50, 2), prose(50, 3)
    data = [(5, a)] * 3 + [(5, b), (9, b), (7, c), (None, c), (None, prose(50, 4)), (None, None)]
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_copy_classes(documents(data)).collect())
    missing = [("None", 0, "None"), ("None", 46, "7"), ("None", 46, "None")]
    assert found == [("5", 46, "5")] * 4 + [("7", 46, "7"), ("9", 46, "5")] + missing


def test_first_of_each_class(documents, prose):
    a, c = prose(80, 1), prose(50, 3)
    data = [(5, a)] * 3 + [(4, a + " x"), (9, prose(40, 7)), (7, c), (None, c), (1, None), (2, None)]
    docs = documents(data, "'k' AS text_hash")
    kept = first_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7, 9]


def test_empty_table(documents):
    assert near_copy_classes(documents([])).collect() == []
    assert first_of_each_class(documents([])).collect() == []


def test_every_close_pair_shares_a_key():
    r = np.random.default_rng(1)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 63, 64, 65, 100, 128, 200, 256, 300]:
        for _ in range(30):
            a = np.unique(mix64(r.integers(0, 2**62, n, np.uint64)))
            gone = int(r.integers(0, len(a) // 5 + 1))
            added = int(r.integers(0, len(a) // 4 + 1))
            b = np.unique(np.concatenate((a[gone:], mix64(r.integers(0, 2**62, added, np.uint64)))))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
                assert len(np.intersect1d(band_keys(a)[0], band_keys(b)[0]))
                apart = np.bitwise_count(bit_sketch(a) ^ bit_sketch(b)).sum()
                assert apart <= len(a) + len(b) - 2 * common <= most_different(len(a), len(b))


def test_bands_of_possible_partners_meet():
    for a in range(1, 400):
        for b in range(a, a * 5 // 4 + 1):
            both = {x[:2]: x[2] for x in bands(a)}.keys() & {x[:2]: x[2] for x in bands(b)}.keys()
            bounds = [{x[:2]: x[2] for x in bands(n)} for n in (a, b)]
            assert any(min(x[band] for x in bounds) >= most_different(a, b) for band in both)


def test_word_hashes_follow_words():
    texts = ["One two  one", "", "ÄÖ é", " lead\ttrail ", "\x0b\x1f a", "é" * 1000]
    hashes, firsts = word_hashes([t.encode() for t in texts])
    names = {}
    for i, t in enumerate(texts):
        words = WORD.findall(t.translate(LOWER))
        part = hashes[firsts[i] : firsts[i + 1]]
        assert len(words) == len(part)
        for w, h in zip(words, part):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    assert len(shingle_hashes(hashes[:2], 5)) == 1
