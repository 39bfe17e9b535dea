"""Comparison of ``orders`` with an edited copy of itself."""

from pyspark.sql import DataFrame, functions as F

from ledgerline.operators import compare, digest
from ledgerline.operators.compare import CompareSpec
from ledgerline.plans.reports import CompareJob, compare_many
from ledgerline.suite.registry import Tables, query

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"]
SPEC = CompareSpec(keys=["o_orderkey"])
TEXT_SPEC = CompareSpec(keys=["o_orderkey"], ignore_columns=["o_totalprice"])
IGNORED = [{"o_orderkey": k} for k in (1, 51, 101, 151)]
IGNORE_SPEC = CompareSpec(keys=["o_orderkey"], ignore_columns=["o_totalprice"], ignore_keys=IGNORED)


def orders_left(t: Tables) -> DataFrame:
    return t.orders.select(*COLUMNS)


def orders_right(t: Tables) -> DataFrame:
    """The whole of ``orders`` with edits: changed cells, removed, new and repeated keys."""
    key = F.col("o_orderkey")
    edited = (
        t.orders.select(*COLUMNS)
        .filter(key % 97 != 0)
        .select(
            "o_orderkey",
            (F.col("o_custkey") + (key % 33 == 0).cast("long")).alias("o_custkey"),
            F.when(key % 60 == 7, F.lit(None)).when(key % 41 == 3, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
            F.when(key % 50 == 1, F.lit("9-EDITED")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
            F.when(key % 70 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
            "o_orderdate",
        )
    )
    added = t.orders.select(*COLUMNS).filter(key % 89 == 0).withColumn("o_orderkey", key + 1_000_000_000)
    repeated = edited.filter(key % 101 == 5).withColumn("o_orderstatus", F.lit("Z"))
    return edited.unionAll(added).unionAll(repeated)


SIDES = """l AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate FROM orders),
edited AS (SELECT o_orderkey, o_custkey + CAST(o_orderkey % 33 = 0 AS BIGINT) AS o_custkey,
    CASE WHEN o_orderkey % 60 = 7 THEN NULL WHEN o_orderkey % 41 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 50 = 1 THEN '9-EDITED' ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN o_orderkey % 70 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate
    FROM l WHERE o_orderkey % 97 <> 0),
r AS (SELECT * FROM edited
    UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate
              FROM l WHERE o_orderkey % 89 = 0
    UNION ALL SELECT o_orderkey, o_custkey, 'Z', o_orderpriority, o_totalprice, o_orderdate
              FROM edited WHERE o_orderkey % 101 = 5),
r1 AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey NULLS FIRST,
    o_orderstatus NULLS FIRST, o_orderpriority NULLS FIRST, o_totalprice, o_orderdate) = 1),
m AS (SELECT l.o_orderkey AS k, l.o_custkey AS lc, r1.o_custkey AS rc, l.o_orderstatus AS ls, r1.o_orderstatus AS rs,
    l.o_orderpriority AS lp, r1.o_orderpriority AS rp, l.o_totalprice AS lt, r1.o_totalprice AS rt,
    l.o_orderdate AS ld, r1.o_orderdate AS rd FROM l JOIN r1 USING (o_orderkey)),
diff AS (SELECT CAST(k AS VARCHAR) AS o_orderkey, 'o_custkey' AS "column", CAST(lc AS VARCHAR) AS left_value,
        CAST(rc AS VARCHAR) AS right_value FROM m WHERE lc IS DISTINCT FROM rc
    UNION ALL SELECT CAST(k AS VARCHAR), 'o_orderstatus', ls, rs FROM m WHERE ls IS DISTINCT FROM rs
    UNION ALL SELECT CAST(k AS VARCHAR), 'o_orderpriority', lp, rp FROM m WHERE lp IS DISTINCT FROM rp
    UNION ALL SELECT CAST(k AS VARCHAR), 'o_orderdate', CAST(ld AS VARCHAR), CAST(rd AS VARCHAR) FROM m
              WHERE ld IS DISTINCT FROM rd),
pairs AS (SELECT "column", left_value, right_value, count(*) AS count, CAST(min(CAST(o_orderkey AS BIGINT)) AS VARCHAR) AS example_o_orderkey FROM diff GROUP BY ALL)"""

MISMATCH_SQL = f"""WITH {SIDES} SELECT 'o_custkey' AS "column", count(*) FILTER (lc IS DISTINCT FROM rc) AS mismatches FROM m
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (ls IS DISTINCT FROM rs) FROM m
    UNION ALL SELECT 'o_orderpriority', count(*) FILTER (lp IS DISTINCT FROM rp) FROM m
    UNION ALL SELECT 'o_totalprice', count(*) FILTER (lt IS DISTINCT FROM rt) FROM m
    UNION ALL SELECT 'o_orderdate', count(*) FILTER (ld IS DISTINCT FROM rd) FROM m"""


@query("mismatch_counts", MISMATCH_SQL)
def mismatch_counts(t: Tables) -> DataFrame:
    return compare.mismatch_counts(orders_left(t), orders_right(t), SPEC)


def orders_rarely_edited(t: Tables) -> DataFrame:
    """The whole of ``orders`` with rare edits: changed and emptied cells, removed and new keys."""
    mark = F.col("o_orderkey") % 401
    edited = t.orders.filter(mark != 17)
    edited = edited.withColumn("o_totalprice", F.when(mark == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    edited = edited.withColumn("o_orderpriority", F.when(mark == 6, F.lit(None)).otherwise(F.col("o_orderpriority")))
    return edited.unionAll(t.orders.filter(mark == 99).withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))


query("digest_mismatch_counts", MISMATCH_SQL)(lambda t: digest.mismatch_counts(orders_left(t), orders_right(t), SPEC))

query(
    "digest_mismatch_counts_rare",
    """SELECT c AS "column", CASE c WHEN 'o_totalprice' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 401 = 5 AND o_totalprice IS NOT NULL)
            WHEN 'o_orderpriority' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 401 = 6 AND o_orderpriority IS NOT NULL) ELSE 0 END AS mismatches
        FROM (SELECT column_name AS c FROM (DESCRIBE orders)) WHERE c <> 'o_orderkey'""",
)(lambda t: digest.mismatch_counts(t.orders, orders_rarely_edited(t), SPEC))

query(
    "digest_differing_keys",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 401 = 17 THEN 'only_left' ELSE 'differs' END AS state FROM orders
        WHERE o_orderkey % 401 = 17 OR (o_orderkey % 401 = 5 AND o_totalprice IS NOT NULL) OR (o_orderkey % 401 = 6 AND o_orderpriority IS NOT NULL)
        UNION ALL SELECT CAST(o_orderkey + 1000000000 AS VARCHAR), 'only_right' FROM orders WHERE o_orderkey % 401 = 99""",
)(lambda t: digest.differing_keys(t.orders, orders_rarely_edited(t), SPEC))


def _exact(t: Tables, edited: bool) -> DataFrame:
    """Numbers beyond 2^53 in other types on each side; the right side has edits of one unit."""
    key = F.col("o_orderkey")
    cent = F.when(key % 50 == 1, F.lit("0.01").cast("decimal(3,2)")).otherwise(F.lit("0.00").cast("decimal(3,2)"))
    price = key.cast("decimal(19,2)") + F.lit("12345678901234567.01").cast("decimal(19,2)")
    number = F.lit(9007199254740993) + key
    if not edited:
        return t.orders.select("o_orderkey", price.cast("decimal(20,2)").alias("price"), number.alias("number"), F.col("o_orderdate").cast("date").alias("day"))
    return t.orders.select(
        "o_orderkey",
        (price + cent).cast("decimal(22,2)").alias("price"),
        (number - (key % 40 == 3).cast("long")).cast("decimal(20,0)").alias("number"),
        F.timestamp_add("SECOND", (key % 30 == 7).cast("int"), F.col("o_orderdate").cast("date").cast("timestamp")).alias("day"),
    )


query(
    "mismatch_counts_exact",
    """SELECT 'price' AS "column", count(*) FILTER (o_orderkey % 50 = 1) AS mismatches FROM orders
       UNION ALL SELECT 'number', count(*) FILTER (o_orderkey % 40 = 3) FROM orders
       UNION ALL SELECT 'day', count(*) FILTER (o_orderkey % 30 = 7) FROM orders""",
)(lambda t: compare.mismatch_counts(_exact(t, False), _exact(t, True), SPEC))

query(
    "keys_only_left",
    f"WITH {SIDES} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM (SELECT o_orderkey FROM l EXCEPT SELECT o_orderkey FROM r)",
)(lambda t: compare.keys_only_left(orders_left(t), orders_right(t), ["o_orderkey"]))

query(
    "keys_only_right",
    f"WITH {SIDES} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM (SELECT o_orderkey FROM r EXCEPT SELECT o_orderkey FROM l)",
)(lambda t: compare.keys_only_right(orders_left(t), orders_right(t), ["o_orderkey"]))

query(
    "keys_common",
    f"WITH {SIDES} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM (SELECT o_orderkey FROM l INTERSECT SELECT o_orderkey FROM r)",
)(lambda t: compare.keys_common(orders_left(t), orders_right(t), ["o_orderkey"]))

query("mismatch_pairs", f"WITH {SIDES} SELECT * FROM pairs")(
    lambda t: compare.mismatch_pairs(orders_left(t), orders_right(t), TEXT_SPEC)
)

query(
    "mismatch_samples",
    f"""WITH {SIDES} SELECT * FROM diff QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY CAST(o_orderkey AS BIGINT)) <= 5""",
)(lambda t: compare.mismatch_samples(orders_left(t), orders_right(t), TEXT_SPEC, 5))

query("cell_diff_long", f"WITH {SIDES} SELECT * FROM diff")(
    lambda t: compare.cell_diff(orders_left(t), orders_right(t), TEXT_SPEC)
)

query(
    "cell_diff_ignoring_keys",
    f"WITH {SIDES} SELECT * FROM diff WHERE o_orderkey NOT IN ('1', '51', '101', '151')",
)(lambda t: compare.cell_diff(orders_left(t), orders_right(t), IGNORE_SPEC))

query(
    "drop_ignored_keys",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (1, 51, 101, 151)",
)(lambda t: compare.drop_ignored_keys(t.orders.select("o_orderkey", "o_custkey"), IGNORE_SPEC))

query(
    "duplicate_key_counts",
    f"""WITH {SIDES} SELECT 'right' AS side, CAST(o_orderkey AS VARCHAR) AS o_orderkey, count(*) AS count FROM r
        GROUP BY o_orderkey HAVING count(*) > 1""",
)(lambda t: compare.duplicate_key_counts(orders_left(t), orders_right(t), SPEC))

query(
    "row_count_cmp",
    f"""WITH {SIDES} SELECT 'all rows' AS scope, (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows,
            (SELECT count(*) FROM l) = (SELECT count(*) FROM r) AS match
        UNION ALL SELECT 'matched keys', count(*), count(*), true FROM m""",
)(lambda t: compare.row_count_comparison(orders_left(t), orders_right(t), SPEC))

_KEY_JSON = """'{"o_orderkey":"' || o_orderkey || '"}'"""
REPORT_SQL = f"""WITH {SIDES} SELECT section, label, left_value, right_value, CAST(n AS BIGINT) AS n, example FROM (
    SELECT 'rows' AS section, 'left' AS label, NULL AS left_value, NULL AS right_value, count(*) AS n, NULL AS example FROM l
    UNION ALL SELECT 'rows', 'right', NULL, NULL, count(*), NULL FROM r
    UNION ALL SELECT 'matched', 'keys', NULL, NULL, count(*), NULL FROM m
    UNION ALL SELECT 'mismatch_count', c, NULL, NULL, count(d."column"), NULL
        FROM (VALUES ('o_custkey'), ('o_orderstatus'), ('o_orderpriority'), ('o_orderdate')) v(c)
        LEFT JOIN diff d ON d."column" = c GROUP BY c
    UNION ALL SELECT 'only_left', {_KEY_JSON}, NULL, NULL, 1, NULL FROM (SELECT o_orderkey FROM l EXCEPT SELECT o_orderkey FROM r)
    UNION ALL SELECT 'only_right', {_KEY_JSON}, NULL, NULL, 1, NULL FROM (SELECT o_orderkey FROM r EXCEPT SELECT o_orderkey FROM l)
    UNION ALL SELECT 'duplicates_right', {_KEY_JSON}, NULL, NULL, count(*), NULL FROM r GROUP BY o_orderkey HAVING count(*) > 1
    UNION ALL SELECT 'mismatch_pair', "column", left_value, right_value, count,
        '{{"o_orderkey":"' || example_o_orderkey || '"}}' FROM pairs)"""

query("report_rows", REPORT_SQL)(
    lambda t: compare.report_rows(orders_left(t), orders_right(t), TEXT_SPEC, top=None)
)

query(
    "report_rows_top",
    f"""SELECT section, label, left_value, right_value, n, example FROM ({REPORT_SQL})
        QUALIFY section IN ('rows', 'matched', 'mismatch_count') OR row_number() OVER (
            PARTITION BY section, CASE WHEN section = 'mismatch_pair' THEN label ELSE '' END
            ORDER BY n DESC, label, left_value NULLS FIRST, right_value NULLS FIRST) <= 20""",
)(lambda t: compare.report_rows(orders_left(t), orders_right(t), TEXT_SPEC, top=20))


@query(
    "compare_many",
    f"""SELECT 'orders' AS job, * FROM ({REPORT_SQL})
        UNION ALL SELECT 'broken', 'invalid', 'name, both tables and keys are required', NULL, NULL, 0, NULL""",
)
def compare_several(t: Tables) -> DataFrame:
    jobs = [
        CompareJob("orders", "left", "right", TEXT_SPEC),
        CompareJob("broken", "left", "right", CompareSpec(keys=[])),
    ]
    return compare_many(t.spark, jobs, {"left": orders_left(t), "right": orders_right(t)}, top=None)


def by_id_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Line items (many per order) against one edited row per order."""
    left = t.lineitem.select(
        F.col("l_orderkey").alias("lid"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("long").alias("number"), "l_tax"
    )
    right = t.orders.select(
        F.col("o_orderkey").alias("rid"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("number"), "o_orderdate"
    )
    return left, right


query(
    "compare_by_id",
    """WITH j AS (SELECT o_orderkey AS row_id, l_linestatus AS ls, o_orderstatus AS rs, CAST(l_linenumber AS BIGINT) AS ln,
            o_custkey % 7 AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
       SELECT row_id, 'number' AS "column", CAST(ln AS VARCHAR) AS left_value, CAST(rn AS VARCHAR) AS right_value FROM j WHERE ln <> rn
       UNION ALL SELECT row_id, 'status', ls, rs FROM j WHERE ls <> rs""",
)(lambda t: compare.compare_by_id(*by_id_sides(t), "lid", "rid"))

query(
    "match_one_to_many",
    """SELECT o_orderkey AS row_id, l_linestatus AS left_status, o_orderstatus AS right_status, o_orderdate
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)(
    lambda t: compare.match_one_to_many(*by_id_sides(t), "lid", "rid").select(
        "row_id", F.col("l.status").alias("left_status"), F.col("r.status").alias("right_status"), "r.o_orderdate"
    )
)

query(
    "id_row_counts",
    "SELECT count(*) AS left_rows, (SELECT count(*) FROM orders) AS right_rows, count(*) = (SELECT count(*) FROM orders) AS match FROM lineitem",
)(lambda t: compare.id_row_counts(*by_id_sides(t), "lid", "rid"))


@query(
    "paired_source_counts",
    """SELECT 'LEFT_' || n_nationkey AS left_key, CAST(n_nationkey AS VARCHAR) AS right_key,
        (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS left_rows,
        (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS right_rows FROM nation""",
)
def paired_source_counts(t: Tables) -> DataFrame:
    left = t.customer.select(F.concat(F.lit("LEFT_"), F.col("c_nationkey")).alias("source_key"))
    right = t.supplier.select(F.col("s_nationkey").cast("string").alias("source_key"))
    return compare.paired_source_counts(left, right, [(f"LEFT_{i}", str(i)) for i in range(25)])
