import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import callbacks, text, values
from ledgerline.operators import clean, logs, nested
from ledgerline.operators.clean import CleanRules, TargetColumn
from ledgerline.plans.load import clean_rows


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "address, valid",
    [("test@example.com", True), ("", False), (None, False), ("a@b", False), ("a..b@x.com", False), ("a@b.co\n", False), ("x@y.longtld", True), ("x@y.toolongtld", False)],
)
def test_email(spark, address, valid):
    assert one(spark, address, text.is_email) is valid


def test_ids(spark):
    assert one(spark, "a-b-c-d", text.id_prefix) == "a-b"
    assert one(spark, "a-b", text.id_prefix) is None
    assert one(spark, "Some Words - ABC-1-22-XYZ tail", text.id_shape) == "Some Words - ABC-1-22-XYZ"
    assert one(spark, "nothing", text.id_shape) is None


def test_versions(spark):
    assert one(spark, 'x version: "1.2" y', text.version_of) == "1.2"
    assert one(spark, "none", text.version_of) is None
    assert one(spark, "none", lambda c: text.version_is(c, "1")) is False


def test_scrub(spark):
    value = "A^b~c é!-1"
    assert one(spark, value, text.scrub) == "Abc -1"
    assert one(spark, value, lambda c: text.scrub(c, [(text.DELIMITER_CHARS, " ")])) == "A b c -1"


def test_sql_types():
    expected = {"INT(11)": "int", "bigint": "bigint", "varchar(20)": "string", "text": "string", "double": "double",
                "decimal(20,6)": "decimal(38,18)", "date": "date", "datetime": "timestamp", "geometry": "string"}
    assert {n: values.sql_type_to_spark(n).simpleString() for n in expected} == expected


TARGET = [TargetColumn("id", "bigint", False), TargetColumn("at", "timestamp"), TargetColumn("note", "varchar(9)"), TargetColumn("amount", "decimal(20,6)"), TargetColumn("updated_at", "varchar(9)")]


def test_conform_and_clean(spark, rows):
    df = spark.createDataFrame(
        [("x^y!", "1", "2024-01-01 10:00:00", "1.50"), (None, "2", "bad", "zz")], "note string, id string, at string, amount string"
    )
    with pytest.warns(UserWarning, match="updated_at"):
        got = clean_rows(df, TARGET, ["updated_at"], CleanRules(rules=[(text.DELIMITER_CHARS, " ")]))
    assert got.columns == ["id", "at", "note", "amount", "updated_at"]
    assert rows(got) == [(1, datetime.datetime(2024, 1, 1, 10), "x y", 1.5, ""), (2, None, "", None, "")]
    with pytest.raises(ValueError, match="required"):
        clean.conform_schema(df.drop("id"), TARGET)


def test_normalise_fill_and_stamp(spark, rows):
    df = spark.createDataFrame([(None, 1)], "s string, i int").withColumn("d", F.lit("1.5").cast("decimal(5,2)"))
    got = clean.stamp(clean.fill_null_text(clean.normalise_types(df)), "day", datetime.date(2024, 1, 2))
    assert rows(got) == [("", 1, 1.5, datetime.date(2024, 1, 2))]
    assert clean.stamp(df, "now").schema["now"].dataType.simpleString() == "timestamp"
    assert rows(clean.column_metadata(df), "column", "type") == [("d", "decimal(5,2)"), ("i", "int"), ("s", "string")]


def test_json_attributes(spark, rows):
    data = [
        ("John", '[{"name": "John", "age": 30, "dob": "1992-01-15"}, {"name": "Darth", "age": 40, "dob": "1982-05-25"}]'),
        ("Darth", '[{"name": "Darth", "age": 1, "dob": "1900-01-01"}, {"name": "Darth", "age": 45, "dob": "1977-11-03"}]'),
        ("Alice", "[]"),
        ("Bad", "[{"),
        ("None", None),
    ]
    df = spark.createDataFrame(data, "name string, json_data string")
    got = rows(nested.named_attributes(df, "json_data", ["John", "Darth"]))
    day = datetime.date
    assert got == [
        ("Alice", None, None, None, None),
        ("Bad", None, None, None, None),
        ("Darth", None, None, 45, day(1977, 11, 3)),
        ("John", 30, day(1992, 1, 15), 40, day(1982, 5, 25)),
        ("None", None, None, None, None),
    ]


LOG = """2024-01-01 10:00:00 INFO start -hivevar:tablename=t_a
2024-01-01 10:00:05 INFO running
2024-01-01 10:06:00 Completion: 120 Rows loaded to store.t_a
hivevar:tablename=t_b
2024-01-01 11:00:00 INFO begin
2024-01-01 11:02:30 Completion: 50 Rows loaded to store.t_b
2024-01-01 12:00:00 hivevar:tablename=t_c""".split("\n")


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_log(spark, rows, chunk):
    lines = spark.createDataFrame([("f", i, line) for i, line in enumerate(LOG, 1)], "file string, line_no long, line string")
    stats = logs.log_table_stats(lines, chunk_rows=chunk)
    at = lambda h, m, s: datetime.datetime(2024, 1, 1, h, m, s)
    assert rows(stats) == [
        ("f", "t_a", at(10, 0, 0), at(10, 6, 0), 120, 6.0),
        ("f", "t_b", at(11, 0, 0), at(11, 2, 30), 50, 2.5),
        ("f", "t_c", at(12, 0, 0), None, None, None),
    ]
    assert [r["table"] for r in logs.top_tables(stats).collect()] == ["t_a", "t_b"]


def test_nesting_round_trip_with_hot_copies(spark):
    df = spark.range(0, 9000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 10 END AS k", "CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS v")
    wide = nested.nest_rows(df, "k", 50)
    assert wide.agg(F.max(F.size("rows"))).first()[0] < 150
    back = nested.unnest_rows(wide)
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


def test_joined_text_pieces_join_to_the_whole(spark):
    df = spark.createDataFrame([("a", f"{i:03d}") for i in range(25)] + [("b", "x"), ("b", "x"), (None, "y")], "k string, v string")
    parts = nested.joined_text(df, ["k"], "v", 10).orderBy("k", "piece").collect()
    joined = {}
    for r in parts:
        joined.setdefault(r.k, []).append(r.text)
    assert {k: ",".join(p) for k, p in joined.items()} == {None: "y", "a": ",".join(f"{i:03d}" for i in range(25)), "b": "x,x"}
    assert len(joined["a"]) == 3


def test_cells(spark, rows):
    cells = spark.createDataFrame(
        [("row1", "family", "q1", "old", 1), ("row1", "family", "q1", "value1", 2), ("row1", "family", "q2", "value2", 1)],
        "row_key string, family string, qualifier string, value string, at int",
    )
    assert rows(nested.cells_to_json(cells, "at", 100), "row_key", "json") == [("row1", '{"family:q1":"value1","family:q2":"value2"}')]
    assert nested.row_cells(cells, "row1").count() == 3


def test_conflicts(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "z"), (2, "a")], "age int, name string")
    listed = spark.createDataFrame([(1, "a"), (1, "b")], "age int, name string")
    assert rows(nested.name_conflicts(df, "age", "name", listed, with_text=True)) == [
        (1, "a", "No Conflict"), (1, "z", "Conflict with a, b"), (2, "a", "Conflict with ")]
    missing = spark.createDataFrame([(1, None), (None, "a"), (1, "a"), (1, "a")], "age int, name string")
    more = listed.union(spark.createDataFrame([(None, "a"), (1, None), (1, "a")], "age int, name string"))
    assert [r[2] for r in rows(nested.name_conflicts(missing, "age", "name", more))] == ["No Conflict"] * 2 + ["Conflict"] * 2


def test_callbacks(spark, rows):
    df = spark.createDataFrame([(i,) for i in range(5)], "k long")
    assert rows(callbacks.enrich(df, lambda r: r["k"] * 2, "twice", "long")) == [(i, i * 2) for i in range(5)]
    assert rows(callbacks.apply_partitions(df, lambda t: t.filter([k > 3 for k in t["k"].to_pylist()]), df.schema)) == [(4,)]


@pytest.mark.parametrize("size", [2, 100_000])
def test_shape_does_not_depend_on_the_size(spark, size):
    df = spark.createDataFrame([(k, f"v{i}") for k in (1, 2) for i in range(7)], "k int, v string")
    cells = df.selectExpr("CAST(k AS STRING) AS row_key", "'f' AS family", "v AS qualifier", "v AS value", "1 AS at")
    for result in (nested.nest_rows(df, "k", size), nested.distinct_values(df, ["k"], "v", size), nested.joined_text(df, ["k"], "v", size), nested.cells_to_json(cells, "at", size)):
        assert result.columns[1] == "piece" and result.count() == (2 if size > 7 else result.count()) >= 2


def test_callbacks_keep_long_values_dates_and_nulls(spark, rows):
    import datetime
    from decimal import Decimal

    schema = "a long, b date, c timestamp, d decimal(20,2), e string, f array<int>, g boolean, h double"
    day, at = datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    data = [(9007199254740993, day, at, Decimal("1.10"), "x", [1, None], True, 0.5), (None,) * 8]
    df = spark.createDataFrame(data, schema).coalesce(1)
    assert rows(callbacks.enrich(df, lambda r: r["a"], "seen", "long")) == sorted([(*r, r[0]) for r in data], key=repr)
    assert rows(callbacks.apply_partitions(df, lambda t: t, df.schema)) == sorted(data, key=repr)
