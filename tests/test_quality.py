import pytest
from pyspark.sql import functions as F

from ledgerline.operators import partition, profile, quality
from ledgerline.plans.reports import profile_table


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame([("a", 1), ("", None), ("  ", 3), (None, 4)], "c_text string, c_int int")


def test_blanks_and_nulls(gaps, rows):
    assert rows(quality.blank_counts(gaps)) == [("c_text", 2)]
    assert rows(quality.blank_counts(gaps, only_found=False)) == [("c_int", 0), ("c_text", 2)]
    assert rows(quality.null_counts(gaps, ["c_text", "c_int"])) == [("c_int", 1, 1, True), ("c_text", 1, 3, True)]


def test_counts_of_an_empty_table(gaps, rows):
    empty = gaps.limit(0)
    assert rows(quality.blank_counts(empty, only_found=False)) == [("c_int", 0), ("c_text", 0)]
    assert rows(quality.total_of(quality.count_by(empty, ["c_int"]))) == [(0,)]
    with pytest.raises(ValueError):
        quality.null_counts(gaps, [])


def test_wide_tables_take_several_passes(spark, rows):
    wide = spark.range(10).select(*[F.when(F.col("id") > i % 10, F.col("id")).alias(f"c{i}") for i in range(120)])
    got = dict((c, n) for c, n, _, _ in rows(quality.null_counts(wide, wide.columns)))
    assert got == {f"c{i}": i % 10 + 1 for i in range(120)}


def test_validate_counts(spark, rows):
    df = spark.createDataFrame([("f1", "r1", 2), ("f1", "r2", 2), ("f2", "r1", 3)], "file_id string, record_id string, n int")
    assert rows(quality.validate_counts(df, "file_id", "n", "record_id")) == [("f1", 2, 2, 1), ("f2", 1, 3, 0)]


def test_keywords(spark):
    names = spark.createDataFrame([("cust_id",), ("cust_name",), ("order_id",)], "column string")
    got = [tuple(r) for r in quality.keyword_counts(names, "column").collect()]
    assert got == [("cust", 2), ("id", 2), ("name", 1), ("order", 1)]
    dotted = spark.createDataFrame([("a.b.",)], "column string")
    assert [tuple(r) for r in quality.keyword_counts(dotted, "column", ".").collect()] == [("", 1), ("a", 1), ("b", 1)]
    assert quality.column_names({"t": names}).count() == 1


COLUMNS = {
    "n": (["1", "-2", "3", "4", "x"], (4, 4, 1, 0, 0, 2, 5, "BIGINT")),
    "f": (["1.5", "2.5", "3", "4.0", "a1"], (1, 4, 0, 0, 0, 3, 5, "FLOAT")),
    "t": (["ab", "cd", "ef", "gh", "1"], (1, 1, 4, 0, 0, 2, 5, "TEXT")),
    "d": (["2024-01-01"] * 4 + ["x"], (0, 0, 1, 4, 0, 10, 5, "DATE")),
    "ts": (["2024-01-01 10:00:00"] * 5, (0, 0, 0, 0, 5, 19, 5, "DATETIME")),
    "m": (["ab1", "1", "x", "2.5", "-"], (1, 2, 1, 0, 0, 3, 5, "UNKNOWN")),
    "z": ([None] * 5, (0, 0, 0, 0, 0, None, 0, "BIGINT")),
}


def test_profile(spark):
    data = list(zip(*[values for values, _ in COLUMNS.values()]))
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in COLUMNS))
    got = {r["column"]: tuple(r)[1:] for r in profile_table(df).collect()}
    assert got == {c: expected for c, (_, expected) in COLUMNS.items()}


def test_number_gate_admits_every_castable_text(spark):
    texts = ["1", " 2 ", "+3", "-4.", ".5", "1e5", "1E-5", "1.5d", "2f", "NaN", "inf", "-Infinity", "0x1p3", "abc", "1-2", "", "-", "."]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    plain = df.agg(*[F.count(F.col("v").try_cast(t)).alias(n) for n, t in profile.CASTS.items()]).first()
    gated = profile.profile_try_cast(df).first()
    assert {n: gated[n] for n in profile.CASTS} == plain.asDict()


def test_partition_formulas(spark, rows):
    df = spark.range(5000).selectExpr("id % 7 AS k")
    assert rows(partition.choose_partitions(df, "k", 8, exact=True)) == [(5000, 7, 5)]
    assert rows(partition.choose_partitions(df.limit(0), "k", 8)) == [(0, 0, 1)]
    assert rows(partition.choose_partitions_by_rows(df)) == [(5000, 10)]
    assert rows(partition.choose_partitions_by_rows(df.limit(4), test_slice=True)) == [(4, 4)]


def next_fit(sizes, capacity):
    bins, current, load = [], 0, 0
    for size in sizes:
        if load and load + size > capacity:
            current, load = current + 1, 0
        bins.append(current)
        load += size
    return bins


@pytest.mark.parametrize("sizes, bins", [([5, 4, 3, 3, 1], 2), ([1] * 50, 7), ([100, 1, 1, 1], 4), ([3, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1], 5), ([7], 3), ([2, 2, 2], 50)])
def test_packing_equals_a_loop(spark, sizes, bins):
    sizes = sorted(sizes, reverse=True)
    counts = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "key int, n long")
    got = [r.bin for r in partition.pack_keys(counts, "key", "n", bins).orderBy("key").collect()]
    assert got == next_fit(sizes, sum(sizes) // bins)


def test_missing_bin_is_zero(spark, rows):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    bins = spark.createDataFrame([("a", 3)], "k string, bin int")
    assert rows(partition.assign_bins(df, bins, "k")) == [("a", 3), ("b", 0)]


def test_masks_settle_casts_as_trying_every_value(spark, rows):
    import random

    from ledgerline.operators import profile

    r = random.Random(4)
    known = ["1", "-12", "+3", " 7 ", "1.5", ".5", "5.", "1e5", "1E-3", "2d", "3f", "nan", "NaN", "inf", "-Infinity", "0x1p3", "", "abc", "a b", None, "9" * 19, "9" * 30]
    known += ["1.2.3", "2024-01-02", "2024-13-01", "2024-1-2", "2024", "20240", "1234567", "12345678", "2024-01-02 10:00:00", "2024-01-02T10:00:00Z", "T10:11", "10:11:12"]
    known += ["2024-02-30", "+2024-01-01", "2024-01-02 10:00:00.123456", "x" * 60, "1" * 60, "0." + "1" * 50, "\t5\n", "--1", "1-URGENT", "é1", "٣", "true", "1_000", "1,5"]
    for _ in range(400):
        known.append("".join(r.choice("0192.+-eE aTnif:dZ") for _ in range(r.randrange(1, 12))))
    df = spark.createDataFrame([(v, str(i)) for i, v in enumerate(known)], "mixed string, number string")
    assert rows(profile.profile_casts_by_mask(df)) == rows(profile.profile_try_cast(df))
    assert rows(profile.profile_casts_by_mask(df.filter("false"))) == []
