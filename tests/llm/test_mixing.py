import random
from collections import Counter, defaultdict

import pytest

from ledgerline.llm.mixing import mix_sources, mixed_documents


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Reshare the excess of full sources until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        wanted = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and wanted[s] > most * sizes[s]}
        if not above:
            return wanted
        full |= above


def rows(seed, n=300, sources=8):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = r.choice(["hot"] * sources + [f"s{k}" for k in range(sources)] + [None])
        text = r.choice([None, "", " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(1, 60)))])
        out.append((i, text, source))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_met_exactly(documents, seed):
    data = rows(seed)
    found = mix_sources(documents(data, "1 AS taken").selectExpr("*", "2 AS size", "3 AS words")).collect()
    sizes = defaultdict(int)
    for _, text, source in data:
        sizes[source] += len((text or "").split())
    wanted = targets(dict(sizes))
    source_of = {i: s for i, _, s in data}
    taken = Counter()
    for r in found:
        taken[source_of[r.doc_id]] += r.taken
        assert r.source_size == sizes[source_of[r.doc_id]]
        assert r.target == pytest.approx(wanted[source_of[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
    assert len(found) == len(data)
    for s, t in wanted.items():
        assert taken[s] == pytest.approx(t, abs=1.01)


def test_reruns_and_partitions_agree(documents):
    docs = documents(rows(5))
    one = sorted(map(tuple, mix_sources(docs.repartition(7)).collect()))
    assert one == sorted(map(tuple, mix_sources(docs.coalesce(1)).collect()))


def test_equal_rows_are_cut_alike(documents):
    docs = documents([(1, "a b c d", "x")] * 10 + [(2, "a b", "y"), (None, None, None), (None, "q", None)])
    found = mix_sources(docs).collect()
    assert len(found) == 13
    assert len({r.taken for r in found if r.doc_id == 1}) == 1


def test_empty_and_wordless(documents):
    assert mix_sources(documents([])).collect() == []
    found = mix_sources(documents([(1, None, "a"), (2, " \n", None)])).collect()
    assert [(r.taken, r.target) for r in found] == [(0, 0.0)] * 2


def test_documents_are_repeated_and_cut(documents):
    data = rows(9)
    docs = documents(data, "'c' AS size")
    wanted = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
    text_of = {i: t for i, t, _ in data}
    words = Counter()
    for r in mixed_documents(docs).collect():
        words[r.doc_id] += len(r.text.split())
        assert text_of[r.doc_id].startswith(r.text)
        assert r.n_chars == len(r.text)
    assert words == Counter({k: v for k, v in wanted.items() if v})
    assert mixed_documents(docs).columns == docs.columns
