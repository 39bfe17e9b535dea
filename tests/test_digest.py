"""Comparison by digests of key ranges."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import compare, digest
from ledgerline.operators.compare import CompareSpec

SCHEMA = "k long, part string, amount decimal(12,2), note string, day date, ratio double"
SPEC = CompareSpec(keys=["k", "part"])


def sides(spark, edits, n=3000):
    rng = random.Random(edits)
    left = spark.range(n).selectExpr(
        "id AS k", "IF(id % 50 = 0, NULL, concat('p', id % 3)) AS part", "CAST(id * 7 % 1000 / 4 AS decimal(12,2)) AS amount",
        "IF(id % 7 = 0, NULL, concat('n', id % 11)) AS note", "date_add(DATE'2024-01-01', CAST(id % 90 AS int)) AS day", "id / 3 AS ratio",
    )
    left = left.unionByName(left.filter("k % 100 = 3"))  # repeated keys
    chosen = rng.sample(range(n), edits)
    kinds = {k: rng.randrange(5) for k in chosen}
    if not chosen:
        return left, left.select(*left.columns)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("k"))
    right = left.withColumn("_kind", F.coalesce(kind, F.lit(-1))).filter("_kind <> 0")
    right = right.selectExpr(
        "IF(_kind = 1, k + 1000000, k) AS k", "part", "IF(_kind = 2, amount + 0.01, amount) AS amount",
        "IF(_kind = 3, IF(note IS NULL, 'x', NULL), note) AS note", "IF(_kind = 4, NULL, day) AS day", "ratio",
    )
    return left, right


@pytest.mark.parametrize("edits", [0, 7, 2500])
def test_equal_to_the_whole_comparison(spark, rows, edits):
    left, right = sides(spark, edits)
    for both in (digest.narrowed(left, right, SPEC), digest.narrowed(left, right, SPEC, pass_bits=3, small_range=2)):
        assert rows(compare.mismatch_counts(both.left, both.right, SPEC)) == rows(compare.mismatch_counts(left, right, SPEC))
        assert rows(compare.cell_diff(both.left, both.right, SPEC)) == rows(compare.cell_diff(left, right, SPEC))
        for keys in (compare.keys_only_left, compare.keys_only_right):
            assert rows(keys(both.left, both.right, SPEC.keys)) == rows(keys(left, right, SPEC.keys))
        assert both.rows <= left.count() + right.count()
    if edits == 0:
        assert (both.ranges, both.rows) == (0, 0)
    if edits == 7:
        assert both.rows < 500


def test_nulls_are_content(spark, rows):
    schema = "k int, a string, b string"
    left = spark.createDataFrame([(1, None, "x"), (2, "x", None), (None, "n", "n")], schema)
    right = spark.createDataFrame([(1, "x", None), (2, "x", None), (None, "n", None)], schema)
    spec = CompareSpec(keys=["k"])
    assert rows(digest.mismatch_counts(left, right, spec)) == [("a", 1), ("b", 2)]
    assert rows(digest.differing_keys(left, right, spec)) == [("1", "differs"), (None, "differs")]


def test_types_and_ignored_keys_and_empty_sides(spark, rows):
    left = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, v int")
    right = spark.createDataFrame([("1", 5), ("2", 7), ("3", 8)], "k string, v long")
    spec = CompareSpec(keys=["k"], ignore_keys=[{"k": 3}])
    assert rows(digest.mismatch_counts(left, right, spec)) == [("v", 1)]
    assert rows(digest.differing_keys(left, right, spec)) == [("2", "differs")]
    assert rows(digest.mismatch_counts(left, right.filter("false"), spec)) == [("v", 0)]
    with pytest.raises(ValueError):
        digest.mismatch_counts(left, right, CompareSpec(keys=["w"]))


def test_shuffled_bytes_follow_the_differences(spark):
    def shuffled(job):
        store = spark.sparkContext._jsc.sc().statusStore()
        total = lambda: sum(e.totalShuffleWrite() for e in _java_list(store.executorList(False)))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = total()
        job()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return total() - before

    def _java_list(seq):
        return [seq.apply(i) for i in range(seq.size())]

    n = 200_000
    few, many = sides(spark, 4, n), sides(spark, 400, n)
    whole = shuffled(lambda: compare.mismatch_counts(*few, SPEC).collect())
    small = shuffled(lambda: digest.mismatch_counts(*few, SPEC).collect())
    more = shuffled(lambda: digest.mismatch_counts(*many, SPEC).collect())
    assert small < whole / 5
    assert small < more
