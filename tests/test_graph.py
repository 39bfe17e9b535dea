import random

import numpy as np
import pytest

from ledgerline.operators import graph


def closure(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(20)],
        [(i, 0) for i in range(1, 20)] + [(0, 0)],
        [(1, 2), (2, 3), (3, 1), (4, 1)],
        [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)],
        [],
    ],
)
def test_hierarchy(spark, rows, edges):
    df = spark.createDataFrame(edges, "user_id long, mgr_id long")
    assert rows(graph.hierarchy(df)) == sorted(closure(edges), key=repr)


def components(vertices, edges):
    label = {v: v for v in vertices}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    vertices = list(range(60))
    edges = [(rng.choice(vertices), rng.choice(vertices)) for _ in range(45)]
    got = graph.connected_components(
        spark.createDataFrame([(v,) for v in vertices], "id long"), spark.createDataFrame(edges, "src long, dst long")
    )
    assert {r.id: r.component for r in got.collect()} == components(vertices, edges)


@pytest.mark.parametrize("seed", range(8))
def test_components_over_many_tasks(spark, seed):
    rng = random.Random(seed)
    vertices = list(range(300))
    near = [(v, v + rng.choice([1, 1, 2, 7])) for v in vertices if rng.random() < 0.8 and v < 290]
    edges = near + [(rng.choice(vertices), rng.choice(vertices)) for _ in range(seed * 8)] + [(5, None), (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    got = graph.connected_components(spark.createDataFrame([(v,) for v in vertices], "id long"), df, edges_at_once=9)
    known = [e for e in edges if None not in e]
    assert {r.id: r.component for r in got.collect()} == components(vertices, known)


def test_union_find_on_arrays():
    rng = random.Random(5)
    for n in (1, 2, 10, 200):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        a, b = (np.array([e[i] for e in edges]) for i in (0, 1))
        assert graph.smallest_of_each(n, a, b).tolist() == list(components(range(n), edges).values())
    path = np.arange(100_000)
    assert not graph.smallest_of_each(100_001, path, path + 1).any()


def test_components_with_text_ids_loops_and_loners(spark):
    vertices = spark.createDataFrame([(str(i), f"n{i}") for i in range(1, 9)], "id string, name string")
    edges = spark.createDataFrame([(str(i), str(i + 1), "friend") for i in range(1, 6)] + [("8", "8", "self")], "src string, dst string, relationship string")
    got = {r.id: r.component for r in graph.connected_components(vertices, edges).collect()}
    assert got == {**{str(i): "1" for i in range(1, 7)}, "7": "7", "8": "8"}


def test_lineage(spark, rows):
    edges = spark.createDataFrame(
        [(1, "a", "b"), (1, "a", "c"), (2, "b", "d"), (2, "c", "d"), (2, "c", "d")],
        "stage_seq_no int, source_table string, dest_table string",
    )
    assert rows(graph.degrees(edges)) == [("a", 0, 2), ("b", 1, 1), ("c", 1, 1), ("d", 2, 0)]
    assert rows(graph.stage_rank(edges)) == [(1, 0), (2, 1)]
    assert rows(graph.lineage_nodes(edges)) == [("a", 0, 2, 0), ("b", 1, 1, 1), ("c", 1, 1, 1), ("d", 2, 0, 0)]
