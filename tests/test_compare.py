import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from ledgerline.operators import compare
from ledgerline.operators.compare import CompareSpec
from ledgerline.plans.reports import CompareJob, compare_many

PEOPLE = "id string, dept_id string, name string, age int, city string, notes string"
LEFT = [
    ("1", "10", "Ann", 25, "Oslo", "a"),
    ("2", "20", "Bob", 30, "Rome", "b"),
    ("3", "30", "Cid", 45, "Bern", "c"),
    ("4", "40", "Dee", 45, "Kiel", "d"),
    ("5", "50", "Eve", 50, "Graz", "e"),
    ("6", "60", "Fay", None, "Lyon", "f"),
]
RIGHT = [
    ("1", "10", "Ann", 26, "Oslo", "x"),
    ("2", "20", "Bob", 30, None, "x"),
    ("3", "30", "Cid", 666, "Bern", "x"),
    ("4", "40", "Dee", 666, "Kiels", "x"),
    ("6", "60", "Fay", None, "Lyon", "x"),
    ("7", "70", "Gus", 41, "Metz", "x"),
]
SPEC = CompareSpec(keys=["id", "dept_id"], ignore_columns=["notes"])


@pytest.fixture
def sides(spark):
    return spark.createDataFrame(LEFT, PEOPLE), spark.createDataFrame(RIGHT, PEOPLE)


def test_counts_pairs_and_keys(sides, rows):
    left, right = sides
    assert rows(compare.mismatch_counts(left, right, SPEC)) == [("age", 3), ("city", 2), ("name", 0)]
    assert rows(compare.keys_only_left(left, right, SPEC.keys)) == [("5", "50")]
    assert rows(compare.keys_only_right(left, right, SPEC.keys)) == [("7", "70")]
    assert len(rows(compare.keys_common(left, right, SPEC.keys))) == 5
    assert rows(compare.mismatch_pairs(left, right, SPEC)) == [
        ("age", "25", "26", 1, "1", "10"),
        ("age", "45", "666", 2, "3", "30"),
        ("city", "Kiel", "Kiels", 1, "4", "40"),
        ("city", "Rome", None, 1, "2", "20"),
    ]


def test_ignored_keys_and_columns(sides, rows):
    left, right = sides
    spec = CompareSpec(keys=["id"], ignore_columns=["notes", "city"], ignore_keys=[{"id": 1}, {"id": "3"}])
    assert rows(compare.mismatch_counts(left, right, spec)) == [("age", 1), ("dept_id", 0), ("name", 0)]
    # one-sided keys are found on all rows, before the ignore list
    spec = CompareSpec(keys=["id"], ignore_keys=[{"id": 5}])
    assert ("only_left", '{"id":"5"}') in rows(compare.report_rows(left, right, spec), "section", "label")


def test_invalid_specs(sides):
    left, right = sides
    with pytest.raises(ValueError, match="key column"):
        compare.mismatch_counts(left, right, CompareSpec(keys=["nope"]))
    with pytest.raises(ValueError, match="lacks"):
        compare.mismatch_counts(left, right, CompareSpec(keys=["id"], ignore_keys=[{"other": 1}]))


def test_nulls_and_duplicates(spark, rows):
    schema = "k int, v string"
    left = spark.createDataFrame([(1, None), (2, None), (3, "x"), (3, "y"), (4, "z")], schema)
    right = spark.createDataFrame([(1, None), (2, "a"), (3, "x"), (5, "q")], schema)
    spec = CompareSpec(keys=["k"])
    assert rows(compare.mismatch_counts(left, right, spec)) == [("v", 1)]
    assert rows(compare.cell_diff(left, right, spec)) == [("2", "v", None, "a")]
    assert rows(compare.duplicate_key_counts(left, right, spec)) == [("left", "3", 2)]
    assert rows(compare.row_count_comparison(left, right, spec)) == [
        ("all rows", 5, 4, False),
        ("matched keys", 3, 3, True),
    ]


def test_null_keys_match_each_other(spark, rows):
    left = spark.createDataFrame([(None, 1, "a"), (0, 1, "b"), (None, None, "c")], "k long, j long, v string")
    right = spark.createDataFrame([(None, 1, "x"), (0, 1, "b"), (0, None, "d")], "k int, j long, v string")
    spec = CompareSpec(keys=["k", "j"])
    assert rows(compare.cell_diff(left, right, spec)) == [(None, "1", "v", "a", "x")]
    assert rows(compare.keys_only_left(left, right, spec.keys)) == [(None, None)]
    assert rows(compare.keys_only_right(left, right, spec.keys)) == [("0", None)]


def test_key_types_may_differ(spark, rows):
    left = spark.createDataFrame([(1, 5)], "k int, v int")
    right = spark.createDataFrame([("1", 5)], "k string, v long")
    assert rows(compare.mismatch_counts(left, right, CompareSpec(keys=["k"]))) == [("v", 0)]


def test_hot_key_is_reduced(spark, rows):
    hot = spark.range(0, 30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id % 5 AS v")
    once = hot.filter("k = 7").limit(1)
    spec = CompareSpec(keys=["k"])
    counts = rows(compare.duplicate_key_counts(hot, once, spec))
    assert counts == [("left", "7", 10_001)]


def test_by_id(spark, rows):
    left = spark.createDataFrame(
        [(1, "a", 10, 0), (1, "b", 10, 0), (2, "c", 20, 0), (None, "n", 0, 0)], "lid int, name string, qty int, extra int"
    )
    right = spark.createDataFrame([(1, "a", 10, 1), (2, "c", 21, 1)], "rid int, name string, qty int, other int")
    assert rows(compare.compare_by_id(left, right, "lid", "rid")) == [(1, "name", "b", "a"), (2, "qty", "20", "21")]
    assert rows(compare.id_row_counts(left, right, "lid", "rid")) == [(3, 2, False)]
    assert rows(compare.column_diff(left, right, "lid", "rid")) == [
        ("extra", "left"),
        ("name", "both"),
        ("other", "right"),
        ("qty", "both"),
    ]
    with pytest.raises(Exception, match="not unique"):
        compare.compare_by_id(left, right.union(right.limit(1)), "lid", "rid").collect()
    with pytest.raises(ValueError, match="no common"):
        compare.compare_by_id(left.select("lid", "extra"), right.select("rid", "other"), "lid", "rid")


def test_report_limits_lists_not_totals(spark, rows):
    left = spark.range(0, 200).selectExpr("id AS k", "id AS v")
    right = spark.range(100, 300).selectExpr("id AS k", "id + 1 AS v")
    report = compare.report_rows(left, right, CompareSpec(keys=["k"]), top=3)
    listed = {}
    for section, *_ in rows(report, "section"):
        listed[section] = listed.get(section, 0) + 1
    assert listed == {"rows": 2, "matched": 1, "mismatch_count": 1, "only_left": 3, "only_right": 3, "mismatch_pair": 3}
    assert ("mismatch_count", "v", 100) in rows(report, "section", "label", "n")


def test_compare_many_reports_invalid_jobs(sides, rows):
    left, right = sides
    jobs = [
        CompareJob("good", "l", "r", SPEC),
        CompareJob("gone", "l", "missing_table", SPEC),
        CompareJob("keyless", "l", "r", CompareSpec(keys=[])),
    ]
    result = compare_many(left.sparkSession, jobs, {"l": left, "r": right})
    assert rows(result.filter("section = 'invalid'").select("job")) == [("gone",), ("keyless",)]
    assert result.filter("job = 'good'").count() > 5


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.sampled_from("abc"))), min_size=1, max_size=12))
def test_equal_tables_have_no_differences(spark, data):
    df = spark.createDataFrame(data, "k int, v string")
    spec = CompareSpec(keys=["k"])
    assert compare.cell_diff(df, df, spec).isEmpty()
    assert compare.keys_only_left(df, df, ["k"]).isEmpty()


def test_pairs_join_without_another_shuffle(spark):
    left = spark.range(1000).selectExpr("id AS k", "id AS v")
    right = spark.range(1000).selectExpr("id AS k", "id AS v")
    with_plan = compare.pair_by_key(left, right, CompareSpec(keys=["k"]))
    plan = with_plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize(
    "left, right, a, b",
    [
        ("decimal(20,2)", "decimal(22,2)", "12345678901234567.01", "12345678901234567.02"),
        ("decimal(20,2)", "decimal(22,4)", "1.50", "1.5001"),
        ("bigint", "decimal(20,0)", "9007199254740993", "9007199254740992"),
        ("decimal(38,18)", "decimal(38,0)", "1.000000000000000001", "1"),
        ("decimal(38,18)", "bigint", "0.100000000000000000", "1"),
        ("int", "bigint", "5", "9007199254740993"),
        ("double", "int", "1.5", "1"),
        ("date", "timestamp", "2024-01-01", "2024-01-01 00:00:01"),
        ("string", "int", "01", "1"),
    ],
)
def test_different_values_of_different_types_differ(spark, left, right, a, b):
    ours = spark.sql(f"SELECT 1 AS k, CAST('{a}' AS {left}) AS v")
    theirs = spark.sql(f"SELECT 1 AS k, CAST('{b}' AS {right}) AS v")
    spec = CompareSpec(keys=["k"])
    assert compare.mismatch_counts(ours, theirs, spec).first().mismatches == 1
    equal = ours.selectExpr("k", f"CAST(v AS {right}) AS v")
    if ours.filter(f"CAST(CAST(v AS {right}) AS {left}) <=> v").count() and left != "string":
        assert compare.mismatch_counts(ours, equal, spec).first().mismatches == 0
    assert compare.compare_by_id(ours.withColumnRenamed("k", "id"), theirs.withColumnRenamed("k", "id"), "id", "id").count() == 1


def test_wide_decimals_and_midnights_are_equal(spark):
    pairs = [
        ("CAST('1.5' AS decimal(38,18))", "CAST('1.50' AS decimal(38,2))"),
        ("CAST('0' AS decimal(38,18))", "CAST('0' AS decimal(38,0))"),
        ("CAST('100' AS decimal(38,18))", "CAST('100' AS decimal(38,0))"),
        ("CAST('100' AS decimal(38,18))", "CAST(100 AS bigint)"),
        ("DATE'2024-01-01'", "TIMESTAMP'2024-01-01 00:00:00'"),
        ("CAST(9007199254740993 AS bigint)", "CAST(9007199254740993 AS decimal(19,0))"),
    ]
    for a, b in pairs:
        ours, theirs = spark.sql(f"SELECT 1 AS k, {a} AS v"), spark.sql(f"SELECT 1 AS k, {b} AS v")
        assert compare.mismatch_counts(ours, theirs, CompareSpec(keys=["k"])).first().mismatches == 0, (a, b)


def test_report_says_when_no_keys_are_common(sides, rows):
    left, right = sides
    apart = right.withColumn("id", right.id.cast("int") + 100)
    assert ("note", "no common keys", 0) in rows(compare.report_rows(left, apart, SPEC), "section", "label", "n")
    assert "note" not in {r[0] for r in rows(compare.report_rows(left, right, SPEC), "section")}
