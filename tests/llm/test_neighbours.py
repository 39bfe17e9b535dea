import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.neighbours import MultiIndex, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(pairs, is_query, k=20):
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v in pairs}
    found = {}
    for q in filter(is_query, vectors):
        scored = sorted((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q)
        found[q] = [i for _, i in scored[:k]]
    return found


def result(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(found[r.query_id])
    return found


def test_recall_over_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pairs = [(r.vec_id, r.embedding) for r in df.collect()]
    truth = brute_force(pairs, lambda i: i % 20 == 0)
    found = result(nearest_neighbours(df, F.col("id") % 20 == 0))
    assert found.keys() == truth.keys()
    assert np.mean([len(set(found[q]) & set(truth[q])) / 20 for q in truth]) >= 0.9


def test_small_tables_are_exact_with_ties(spark):
    r = np.random.default_rng(0)
    pairs = [(int(i), r.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)]
    pairs = [(i, v if any(v) else [1.0] * 6) for i, v in pairs]
    df = spark.createDataFrame([(i, v, 0) for i, v in pairs], SCHEMA)
    assert result(nearest_neighbours(df, F.col("id") % 20 == 0)) == brute_force(pairs, lambda i: i % 20 == 0)


def test_one_vector_many_times(spark):
    r = np.random.default_rng(1)
    pairs = [(i, [1.0, 0.5, 0.0, 0.0] if i % 3 == 0 else r.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, 0) for i, v in pairs], SCHEMA).withColumn("id", F.lit(1)).withColumn("cell", F.lit(2))
    assert result(nearest_neighbours(df, F.col("id") % 20 == 0)) == brute_force(pairs, lambda i: i % 20 == 0)


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (40, [3.0, -0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert result(nearest_neighbours(df, F.col("id") % 20 == 0)) == {0: [40, 1], 40: [0, 1]}


def test_no_or_one_usable_vector(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest_neighbours(empty, F.col("id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 0), (20, None, 0)], SCHEMA)
    assert nearest_neighbours(one, F.col("id") % 20 == 0).collect() == []


@pytest.mark.parametrize("k", [1, 3, 8])
def test_pairs_come_by_falling_sum(k):
    r = np.random.default_rng(k)
    index = MultiIndex(r.normal(size=(k, 3)), r.normal(size=(k, 3)), np.ones(k * k, np.int64))
    q = r.normal(size=6)
    sums = (index.first @ q[:3])[:, None] + (index.second @ q[3:])[None, :]
    cells = index.traverse(q, k * k)
    assert sorted(cells) == list(range(k * k))
    taken = sums.ravel()[cells]
    assert (np.diff(taken) <= 1e-12).all()
    assert index.traverse(q, 2) == cells[:2]


def test_an_id_is_found_and_asks_with_each_of_its_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.5], 0), (2, [0.5, 0.0], 0)], SCHEMA)
    found = nearest_neighbours(two, F.col("id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 1.0), (2, 0.5)]
    r = np.random.default_rng(7)
    rows = [(int(i) % 90, r.normal(size=4).round(1).tolist()) for i in range(300)] + [(5, [0.1, 0.2, 0.3, 9.0])] * 3
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    best = {q: {i: max(float((a * b).sum()) for a in vectors[q] for b in vectors[i]) for i in vectors if i != q} for q in vectors if q % 20 == 0}
    truth = {q: sorted(s, key=lambda i: (-s[i], i))[:20] for q, s in best.items()}
    assert result(nearest_neighbours(df, F.col("id") % 20 == 0)) == truth
