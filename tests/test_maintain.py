import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import clean, joins, maintain
from ledgerline.operators.compare import match_one_to_many
from ledgerline.plans.load import SyncTable, sync_with_archive
from ledgerline.sources import sinks

RECORDS = "fileId int, recordId int, data string"
KEYS = ["fileId", "recordId"]


def test_upsert_by_two_keys(spark, rows):
    target = spark.createDataFrame([(1, 1, "Old"), (9, 9, "Keep")], RECORDS)
    source = spark.createDataFrame([(1, 1, "Data1"), (1, 2, "Data2"), (2, 1, "Data3")], RECORDS)
    once = maintain.upsert(target, source, KEYS)
    expected = [(1, 1, "Data1"), (1, 2, "Data2"), (2, 1, "Data3"), (9, 9, "Keep")]
    assert rows(once) == expected
    assert rows(maintain.upsert(once, source, KEYS)) == expected


def test_touch_and_replace(spark, rows):
    target = spark.createDataFrame([("a", 1, "t0")], "n string, amount int, time string")
    source = spark.createDataFrame([("a", 2, "t1")], "n string, amount int, time string")
    assert rows(maintain.upsert_touch(target, source, ["n"], ["time"])) == [("a", 1, "t1")]
    assert rows(maintain.replace(target, source, ["n"])) == [("a", 2, "t1")]
    assert rows(maintain.replace(target, source.drop("time"), ["n"])) == [("a", 2, None)]


def test_repeated_source_keys(spark, rows):
    target = spark.createDataFrame([(1, "x")], "k int, v string")
    source = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 1), (None, "n", 1)], "k int, v string, seq int")
    merged = maintain.upsert(target, source, ["k"], order=["seq"])
    assert rows(merged) == [(1, "b"), (2, "c"), (None, "n"), (None, "n")]
    with pytest.raises(Exception, match="no order"):
        maintain.upsert(target, source.drop("seq"), ["k"]).collect()


def test_upsert_errors(spark):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError, match="key"):
        maintain.upsert(df, df, [])
    with pytest.raises(ValueError, match="no columns"):
        maintain.upsert_non_key(df, df, ["k", "v"])


def test_small_source_leaves_a_large_target_unshuffled(spark):
    target = spark.range(0, 100_000).selectExpr("id AS k", "id AS v")
    source = spark.range(2).selectExpr("id * 200000 + 1 AS k", "id AS v")
    merged = maintain.upsert(target, source, ["k"])
    assert merged.count() == 100_001
    plan = maintain.sync_deletes(target, source, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_hot_keys_are_split_in_joins(spark):
    """With every join shuffled, the side holding a hot key is read in slices."""
    settings_used = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings_used}
    for k, v in settings_used.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(0, 90_000, 1, 6).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
        other = spark.range(0, 90_000, 2, 6).selectExpr("id AS k", "id AS w")
        odd = other.withColumn("k", F.col("k") + 1)
        joined = {
            "semi": (joins.semi_join(hot, odd, ["k"]), 30_000 + 30_000),
            "anti": (joins.anti_by_key(hot, odd, ["k"]), 30_000),
            "one_to_many": (match_one_to_many(hot, odd, "k", "k"), 30_000 + 30_000),
            "upsert": (maintain.upsert(hot, odd.withColumnRenamed("w", "v"), ["k"]), 90_000 + 15_000),
        }
        for name, (df, count) in joined.items():
            assert len(df.collect()) == count, name
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "skew=true" in plan, name
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.integers(0, 8)), max_size=10),
    st.lists(st.one_of(st.none(), st.integers(0, 8)), max_size=10),
)
def test_sync_splits_prod_into_kept_and_deleted(spark, prod_keys, landing_keys):
    prod = spark.createDataFrame([(k, i) for i, k in enumerate(prod_keys)], "k int, i int")
    landing = spark.createDataFrame([(k,) for k in landing_keys], "k int")
    kept = {r.i for r in maintain.sync_deletes(prod, landing, ["k"]).collect()}
    gone = {r.i for r in maintain.deleted_rows(prod, landing, ["k"]).collect()}
    assert kept == {i for i, k in enumerate(prod_keys) if k is not None and k in landing_keys}
    assert gone == set(range(len(prod_keys))) - kept
    assert maintain.deleted_count(prod, landing, ["k"]).first().deleted == len(gone)


def test_sync_tables_with_archive(spark, rows):
    sinks.save_table(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "k int, v string"), "prod_a", "overwrite")
    sinks.save_table(spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "k int, v string"), "landing_a", "overwrite")
    day = datetime.date(2024, 1, 31)
    tables = [SyncTable("prod_a", "landing_a", "deleted_a", ["k"]), SyncTable("prod_b", "landing_b", "deleted_b", [])]
    assert rows(sync_with_archive(spark, tables, day)) == [("prod_a", "synced", 2, 2), ("prod_b", "skipped: no key", None, None)]
    assert rows(spark.table("prod_a")) == [(2, "b"), (3, "c")]
    assert rows(spark.table("deleted_a")) == [(1, "a", day), (None, "n", day)]


def test_sync_after_a_failure_archives_once(spark, rows, monkeypatch):
    import ledgerline.plans.load as load

    day = datetime.date(2024, 2, 1)
    table = [SyncTable("prod_f", "landing_f", "deleted_f", ["k"])]
    sinks.save_table(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), "prod_f", "overwrite")
    sinks.save_table(spark.createDataFrame([(2, "b")], "k int, v string"), "landing_f", "overwrite")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(load, "swap_table", fail)
        with pytest.raises(RuntimeError, match="lost"):
            sync_with_archive(spark, table, day)
    assert rows(spark.table("prod_f"), "k") == [(1,), (1,), (2,)]
    sync_with_archive(spark, table, day)
    sync_with_archive(spark, table, day)
    assert rows(spark.table("deleted_f")) == [(1, "a", day)] * 2
    assert rows(spark.table("prod_f")) == [(2, "b")]


def test_broken_swaps_are_recovered(spark, rows):
    state = spark.createDataFrame([(1,)], "k int")
    for step in ("staged", "aside", "renamed"):
        name = f"swap_{step}"
        sinks.save_table(state, name, "overwrite")
        if step == "staged":
            sinks.save_table(state, f"{name}__next", "overwrite")
        else:
            spark.sql(f"ALTER TABLE {name} RENAME TO {name}__old")
        if step == "renamed":
            sinks.save_table(state, name, "overwrite")
        assert sinks.recover_table(spark, name) == ("restored" if step == "aside" else "cleaned")
        assert rows(spark.table(name)) == [(1,)]
        assert not any(spark.catalog.tableExists(f"{name}__{x}") for x in ("next", "old"))
        sinks.swap_table(spark.table(name).selectExpr("k + 1 AS k"), name)
        assert rows(spark.table(name)) == [(2,)] and sinks.recover_table(spark, name) == "none"


def test_staged_merge_and_swap(spark, rows):
    sinks.save_table(spark.createDataFrame([("a", 1, "t0")], "n string, amount int, time string"), "amounts", "overwrite")
    staging = spark.createDataFrame([("a", 2, "t1"), ("b", 3, "t1")], "n string, amount int, time string")
    sinks.staged_merge(staging, lambda s: maintain.upsert_touch(spark.table("amounts"), s, ["n"], ["time"]), "amounts")
    assert rows(spark.table("amounts")) == [("a", 1, "t1"), ("b", 3, "t1")]


def test_ensure_table(spark):
    df = spark.createDataFrame([], "k int, v string")
    assert sinks.ensure_table(spark, "made_once", df.schema)
    assert not sinks.ensure_table(spark, "made_once", df.schema)
    assert spark.table("made_once").isEmpty()


def test_zero_stripped_join(spark, rows):
    left = spark.createDataFrame([("00120",)], "a string")
    right = spark.createDataFrame([("12",), ("0120",), ("0121",)], "b string")
    assert rows(joins.join_zero_stripped(left, right, "a", "b")) == [("00120", "0120"), ("00120", "12")]


def test_key_columns_per_constraint(spark, rows):
    constraints = spark.createDataFrame(
        [("pk", "s", "t", "PRIMARY KEY"), ("u1", "s", "t", "UNIQUE"), ("c1", "s", "t", "CHECK")],
        "constraint_name string, table_schema string, table_name string, constraint_type string",
    )
    columns = spark.createDataFrame(
        [("u1", "s", "t", "b", 2), ("u1", "s", "t", "a", 1), ("pk", "s", "t", "id", 1), ("c1", "s", "t", "x", 1)],
        "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int",
    )
    got = joins.key_columns(constraints, columns)
    assert rows(got, "constraint_name", "key_columns") == [("pk", ["id"]), ("u1", ["a", "b"])]


def test_update_where(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert rows(clean.update_where(df, F.col("k") == 1, "v", F.lit("z"))) == [(1, "z"), (2, "y")]
