"""Tables laid out by key, and sketches kept per part."""

import uuid

from ledgerline.operators import maintain, partition
from ledgerline.sources import sinks


def test_merge_reads_a_bucketed_target_once_and_leaves_it_in_place(spark, rows):
    name = f"t_{uuid.uuid4().hex}"
    target = spark.range(1000).selectExpr("id AS k", "concat('v', id) AS v", "id * 2 AS w", "CAST(NULL AS string) AS kept")
    sinks.write_bucketed(target.unionByName(target.filter("k = 7")), name, ["k"], 4)
    source = spark.createDataFrame([(7, "new", 1), (7, "newer", 2), (5000, "in", 1), (None, "free", 1)], "k long, v string, seq int")
    merged = maintain.merge_full(spark.table(name), source, ["k"], order=["seq"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Bucketed: true" in plan
    join = plan[plan.index("SortMergeJoin") :]
    left = join[: join.index("FileScan parquet")]
    assert "Exchange" not in left
    whole = maintain.upsert(spark.table(name), source, ["k"], order=["seq"])
    assert rows(merged) == rows(whole) and merged.count() == 1003
    assert rows(merged.filter("k IN (7, 5000) OR k IS NULL"), "k", "v", "w") == sorted([(7, "newer", 14)] * 2 + [(5000, "in", None), (None, "free", None)], key=repr)
    for change in (["v"], ["w"]):
        part = source.withColumn("w", source.seq.cast("long"))
        assert rows(maintain.merge_full(spark.table(name), part, ["k"], change, ["seq"])) == rows(maintain.upsert(spark.table(name), part, ["k"], change, ["seq"]))
    spark.sql(f"DROP TABLE {name}")


def test_sketches_merge_as_the_whole(spark):
    df = spark.range(40_000).selectExpr("id % 30000 AS k", "id % 4 AS part")
    kept = partition.distinct_sketches(df.filter("k < 9000"), "k", "part")
    both = partition.merge_sketches(kept, partition.distinct_sketches(df.filter("k >= 9000"), "k", "part"))
    assert both.count() == 4
    row = partition.choose_partitions_from(both, 4).first()
    assert row.rows == 40_000 and abs(row.distinct_keys - 30_000) <= partition.SKETCH_ERROR * 30_000 and row.partitions == 40
    empty = partition.choose_partitions_from(kept.filter("false"), 4).first()
    assert (empty.rows, empty.distinct_keys, empty.partitions) == (0, 0, 1)
