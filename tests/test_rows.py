import random

from pyspark.sql import functions as F

from ledgerline.operators import rows as R


def test_duplicates(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, "a"), (1, 1, "b"), (1, None, "c"), (1, None, "c"), (1, None, "d"), (2, 1, "e")], "a int, b int, v string"
    )
    keys = ["a", "b"]
    assert rows(R.duplicate_keys(df, keys)) == [(1, 1, 2), (1, None, 3)]
    assert len(rows(R.rows_of_duplicates(df, keys))) == 5
    assert rows(R.keep_first(df, keys, ["v"])) == [(1, 1, "a"), (1, None, "c"), (2, 1, "e")]
    assert rows(R.keep_first(df, keys, ["v"], last=True)) == [(1, 1, "b"), (1, None, "d"), (2, 1, "e")]
    assert rows(R.rows_after_first(df, keys, ["v"])) == [(1, 1, "b"), (1, None, "c"), (1, None, "d")]


def test_hot_copies_are_all_returned(spark):
    df = spark.range(0, 60_000).selectExpr("CASE WHEN id < 40000 THEN 0 ELSE id END AS k", "'same' AS v")
    after = R.rows_after_first(df, ["k"])
    assert after.count() == 39_999
    assert after.select("k").distinct().count() == 1


def test_replicate_spreads_large_counts(spark):
    df = spark.createDataFrame([("a", 35_000), ("b", 2), ("c", 0)], "v string, n long")
    got = {r.v: r["count"] for r in R.replicate(df, "n").groupBy("v").count().collect()}
    assert got == {"a": 35_000, "b": 2}


def test_global_rank_with_hot_value(spark):
    df = spark.range(0, 5000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS a", "id AS b")
    got = {(r.a, r.b): r["rank"] for r in R.global_rank(df, [F.col("a").desc(), F.col("b")]).collect()}
    expected = sorted(got, key=lambda ab: (-ab[0], ab[1]))
    assert [got[ab] for ab in expected] == list(range(1, 5001))


def test_global_rank_of_nothing(spark):
    assert R.global_rank(spark.range(0), [F.col("id")]).isEmpty()


def test_carry_forward_equals_a_loop(spark):
    rng = random.Random(3)
    data = [
        (g, i, rng.choice([None, None, None, f"{g}{i}"]), rng.choice([None, i]))
        for g in ("x", "y", None)
        for i in range(rng.randint(30, 90))
    ]
    expected, last = {}, {}
    for g, i, a, b in data:
        prev = last.get(g, (None, None))
        last[g] = (a if a is not None else prev[0], b if b is not None else prev[1])
        expected[(g, i)] = last[g]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, i long, a string, b long")
    for chunk in (1, 7, 1000):
        got = {(r.g, r.i): (r.a, r.b) for r in R.carry_forward(df, ["g"], "i", ["a", "b"], chunk).collect()}
        assert got == expected


def test_sample_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS v")
    sample = R.sample_per_group(df, ["g"], ["v"], 3)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(tuple(r) for r in sample.collect()) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]


def test_pieces_keep_everything(spark):
    df = spark.range(0, 3000).selectExpr("CASE WHEN id < 2500 THEN 'hot' ELSE 'cold' END AS k", "id AS v")
    placed = R.pieces(df, ["k"], "v", 100)
    sizes = placed.groupBy("k", "piece").count().collect()
    assert sum(r["count"] for r in sizes) == 3000
    assert sum(r.k == "hot" for r in sizes) == 25
    assert max(r["count"] for r in sizes) < 200
