"""Counts, duplicates, blanks and profiles of the given tables."""

from pyspark.sql import DataFrame, functions as F

from ledgerline.operators import profile, quality, rows
from ledgerline.plans.reports import profile_table
from ledgerline.suite.registry import TABLES, Tables, query

LINE_KEY = ["l_orderkey", "l_linenumber"]

query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))(
    lambda t: quality.table_counts({name: getattr(t, name) for name in TABLES})
)

query(
    "count_by",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
)(lambda t: quality.count_by(t.lineitem, ["l_returnflag", "l_linestatus"], "n"))

query("sum_total", "SELECT count(*) AS total FROM lineitem")(
    lambda t: quality.total_of(quality.count_by(t.lineitem, ["l_suppkey"]))
)

query(
    "count_validation",
    """SELECT l_orderkey, count(*) AS record_count, max(l_linenumber) AS declared_count,
              CAST(count(*) = max(l_linenumber) AS INT) AS validation
       FROM lineitem GROUP BY l_orderkey""",
)(lambda t: quality.validate_counts(t.lineitem, "l_orderkey", "l_linenumber"))

query(
    "dup_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)(lambda t: rows.duplicate_keys(t.lineitem, LINE_KEY))

query(
    "dup_rows_all",
    """SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
       WHERE n > 1""",
)(lambda t: rows.rows_of_duplicates(t.lineitem, LINE_KEY))

_ORDERED = """SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem"""

query("dup_rows_after_first", f"SELECT * EXCLUDE (rn) FROM ({_ORDERED}) WHERE rn > 1")(
    lambda t: rows.rows_after_first(t.lineitem, LINE_KEY, ["l_shipdate"])
)

query("keep_first", f"SELECT * EXCLUDE (rn) FROM ({_ORDERED}) WHERE rn = 1")(
    lambda t: rows.keep_first(t.lineitem, LINE_KEY, ["l_shipdate"])
)


def part_with_gaps(t: Tables) -> DataFrame:
    """``part`` with blank and missing values put in, as the given tables hold none."""
    key = F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        F.when(key % 11 == 0, F.lit("   ")).otherwise(F.col("p_name")).alias("p_name"),
        F.when(key % 13 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(key % 7 != 0, F.col("p_type")).alias("p_type"),
        F.when(key % 17 != 0, F.col("p_size")).alias("p_size"),
    )


GAPS = """part_with_gaps AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '   ' ELSE p_name END AS p_name,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS p_brand,
    CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS p_type,
    CASE WHEN p_partkey % 17 <> 0 THEN p_size END AS p_size FROM part)"""

query(
    "blank_counts",
    f"""WITH {GAPS} SELECT 'p_name' AS "column", count(*) AS blanks FROM part_with_gaps WHERE trim(p_name) = ''
        UNION ALL SELECT 'p_brand', count(*) FROM part_with_gaps WHERE trim(p_brand) = ''""",
)(lambda t: quality.blank_counts(part_with_gaps(t)))

query(
    "null_counts",
    "WITH " + GAPS + " UNION ALL ".join(
        f""" SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls,
             count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS nulls_or_blanks,
             count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') > 0 AS warning FROM part_with_gaps"""
        for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    ),
)(lambda t: quality.null_counts(part_with_gaps(t), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]))

query(
    "filter_null_or_blank",
    f"WITH {GAPS} SELECT * FROM part_with_gaps WHERE p_type IS NULL OR trim(p_name) = '' OR trim(p_brand) = ''",
)(lambda t: part_with_gaps(t).filter("p_type IS NULL OR trim(p_name) = '' OR trim(p_brand) = ''"))

query("filter_eq", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")(
    lambda t: t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
)

query("distinct_count", "SELECT count(DISTINCT l_partkey) AS distinct_keys FROM lineitem")(
    lambda t: quality.distinct_count(t.lineitem, ["l_partkey"])
)

query("distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")(
    lambda t: t.lineitem.select("l_partkey", "l_suppkey").distinct()
)

query(
    "keyword_counts",
    """SELECT keyword, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS keyword FROM part) GROUP BY keyword""",
)(lambda t: quality.keyword_counts(t.part, "p_name", " "))

query(
    "keyword_counts_dash",
    """SELECT keyword, count(*) AS count FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS keyword FROM orders)
       GROUP BY keyword""",
)(lambda t: quality.keyword_counts(t.orders, "o_orderpriority", "-"))

_PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def exact_prices(df: DataFrame, price: str) -> DataFrame:
    """Prices as decimals: their text is then the same in every engine."""
    return df.withColumn(price, F.col(price).cast("decimal(15,2)"))


def _regex_sql(table: str, columns: list[str], price: str, recommend: bool) -> str:
    parts = []
    for c in columns:
        value = f"CAST(CAST({c} AS DECIMAL(15,2)) AS VARCHAR)" if c == price else f"CAST({c} AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS \"column\", {value} AS v FROM {table}")
    counts = ", ".join(
        f"count(*) FILTER (regexp_matches(v, '{p}')) AS {name}" for name, p in profile.SHAPES.items()
    )
    sql = f"""SELECT "column", {counts}, CAST(max(length(v)) AS INT) AS max_length, count(v) AS total_count
              FROM ({' UNION ALL '.join(parts)}) GROUP BY "column" """
    if recommend:
        cases = " ".join(f"WHEN {c} >= 0.8 * total_count THEN '{name}'" for name, c in profile.RECOMMENDED)
        sql = f"SELECT *, CASE {cases} ELSE 'UNKNOWN' END AS recommended_data_type FROM ({sql})"
    return sql


query("profile_regex", _regex_sql("part", _PART_COLUMNS, "p_retailprice", False))(
    lambda t: profile.profile_regex(exact_prices(t.part, "p_retailprice"))
)
query("recommend_type", _regex_sql("orders", _ORDER_COLUMNS, "o_totalprice", True))(
    lambda t: profile_table(exact_prices(t.orders, "o_totalprice"))
)

# Only values on whose casts both engines agree: a number like 2024 is a date for one of them.
_CAST_VALUES = {
    "o_orderstatus": "o_orderstatus",
    "o_orderpriority": "o_orderpriority",
    "order_day": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)",
    "order_time": "CAST(o_orderdate AS VARCHAR)",
    "order_month": "CAST(month(o_orderdate) AS VARCHAR)",
}


def _try_cast_sql() -> str:
    parts = [f"SELECT '{name}' AS \"column\", {value} AS v FROM orders" for name, value in _CAST_VALUES.items()]
    casts = {"bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "decimal": "DECIMAL(38,18)", "date": "DATE",
             "datetime": "TIMESTAMP"}
    counts = ", ".join(f"count(TRY_CAST(v AS {target})) AS {name}_count" for name, target in casts.items())
    return f"""SELECT "column", {counts}, count(v) AS char_count, count(v) AS text_count, count(v) AS enum_count,
               count(*) AS total_count FROM ({' UNION ALL '.join(parts)}) GROUP BY "column" """


@query("profile_try_cast", _try_cast_sql())
def profile_try_cast(t: Tables) -> DataFrame:
    orders = t.orders.select(
        "o_orderstatus",
        "o_orderpriority",
        F.col("o_orderdate").cast("date").cast("string").alias("order_day"),
        F.col("o_orderdate").cast("string").alias("order_time"),
        F.month("o_orderdate").cast("string").alias("order_month"),
    )
    return profile.profile_try_cast(orders)


def _gated_sql() -> str:
    """Casts of all columns of ``orders`` by what their texts look like."""
    none, every = "0", "count(v)"
    year, short_year = "count(v) FILTER (length(v) BETWEEN 4 AND 7)", "count(v) FILTER (length(v) BETWEEN 4 AND 6)"
    gates = {  # bigint, float, double, decimal, date, timestamp
        "o_orderkey": (every, every, every, every, year, short_year),
        "o_custkey": (every, every, every, every, year, short_year),
        "o_orderstatus": (none,) * 6,
        "o_orderpriority": (none,) * 6,
        "o_totalprice": (none, every, every, every, none, none),
        "o_orderdate": (none, none, none, none, every, every),
    }
    kinds = ("bigint", "float", "double", "decimal", "date", "datetime")
    parts = [
        f"""SELECT '{c}' AS "column", {", ".join(f"CAST({g} AS BIGINT) AS {k}_count" for k, g in zip(kinds, own))}, count(v) AS char_count, count(v) AS text_count,
            count(v) AS enum_count, count(*) AS total_count FROM (SELECT CAST({c} AS VARCHAR) AS v FROM orders)"""
        for c, own in gates.items()
    ]
    return " UNION ALL ".join(parts)


query("profile_casts_by_mask", _gated_sql())(lambda t: profile.profile_casts_by_mask(t.orders))
query("profile_try_cast_all", _gated_sql())(lambda t: profile.profile_try_cast(t.orders))

query(
    "order_multi",
    """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority""",
)(
    lambda t: quality.count_by(t.orders, ["o_orderpriority"], "n").orderBy(F.col("n").desc(), "o_orderpriority")
)

query("limit_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")(
    lambda t: t.orders.orderBy("o_orderkey").limit(1000)
)

query(
    "partition_sizes",
    "SELECT count(*) AS rows FROM orders",
)(lambda t: quality.total_of(_sizes(t), "rows", "rows"))


def _sizes(t: Tables) -> DataFrame:
    from ledgerline.operators.partition import partition_sizes, repartition_by

    return partition_sizes(repartition_by(t.orders, 8, ["o_custkey"]))
