"""Interval labels against the closure."""

import random

from pyspark.sql import functions as F

from ledgerline.operators.intervals import below_count, interval_labels, is_below


def ancestors(parents):
    out = {}
    for v in parents:
        chain, at = [], parents[v]
        while at is not None:
            chain.append(at)
            at = parents.get(at)
        out[v] = chain
    return out


def check(spark, edges, parents, kind="long"):
    df = spark.createDataFrame(edges, f"user_id {kind}, mgr_id {kind}").repartition(3)
    labels = interval_labels(df).withColumn("n", below_count()).cache()
    found = {r.id: r for r in labels.collect()}
    above = ancestors(parents)
    assert set(found) == set(parents)
    for v, r in found.items():
        assert (r.parent_id, r.level, r.root) == (parents[v], len(above[v]), above[v][-1] if above[v] else v)
        assert r.n == sum(v in chain for chain in above.values())
    pairs = labels.select(F.struct("*").alias("a")).join(labels.select(F.struct("*").alias("b")), F.lit(True)).filter(is_below("a", "b"))
    assert {(r.x, r.y) for r in pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()} == {(v, u) for v, c in above.items() for u in c}
    return found


def test_chain_and_star_and_forest(spark):
    rng = random.Random(2)
    edges = [(i, i - 1) for i in range(1, 30)] + [(100 + i, 50) for i in range(20)]
    edges += [(200 + i, 200 + rng.randrange(i)) for i in range(1, 40)]
    parents = {v: None for e in edges for v in e} | dict(edges)
    check(spark, edges, parents)


def test_cycles_are_cut_at_their_smallest(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 3), (10, 9), (5, 5), (6, 5), (0, 1), (7, None), (4, 8), (4, 6)]
    found = check(spark, edges, {1: None, 2: 3, 3: 1, 9: 3, 10: 9, 5: None, 6: 5, 0: 1, 4: 6})
    assert {v for v, r in found.items() if r.cut} == {1, 5}


def test_text_ids_and_no_edges(spark):
    check(spark, [("b", "a"), ("c", "a"), ("d", "b")], {"a": None, "b": "a", "c": "a", "d": "b"}, "string")
    assert interval_labels(spark.createDataFrame([], "user_id long, mgr_id long")).count() == 0
