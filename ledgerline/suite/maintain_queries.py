"""Joins, upserts, deletes and packing over the given tables."""

import datetime
import uuid

from pyspark.sql import DataFrame, functions as F

from ledgerline.operators import clean, compare, joins, maintain, partition
from ledgerline.operators.quality import count_by
from ledgerline.plans.load import ingest_validate, sync_split
from ledgerline.session import scratch_path
from ledgerline.sources import sinks
from ledgerline.sources.tables import literal_df, scan_sql, scan_table
from ledgerline.suite.compare_queries import SIDES, orders_left, orders_right
from ledgerline.suite.registry import Tables, query

query("scan_table", "SELECT c_custkey, c_name FROM customer")(
    lambda t: scan_table(t.spark, t.path("customer"), ["c_custkey", "c_name"])
)

query(
    "scan_sql",
    "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderkey >= 100",
)(
    lambda t: scan_sql(
        t.spark,
        "SELECT o_orderkey, o_custkey, o_orderpriority FROM {orders} WHERE o_orderstatus = :status AND o_orderkey >= :low",
        {"status": "F", "low": 100},
        orders=t.orders,
    )
)


def files_of(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items as file records, their analytics per (tracking, record), processed files."""
    file_data = t.lineitem.select(
        F.col("l_orderkey").alias("file_id"),
        F.col("l_partkey").alias("tracking_id"),
        F.col("l_suppkey").alias("record_id"),
        F.col("l_linenumber").alias("file_id_rec_count"),
        F.col("l_returnflag").alias("record_notes"),
    )
    analytics = file_data.groupBy("tracking_id", "record_id").agg(F.count(F.lit(1)).alias("record_products"))
    processed = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("tracking_id"))
    return file_data, analytics, processed


query(
    "inner_two_keys",
    """SELECT l_orderkey AS file_id, l_suppkey AS record_id, l_returnflag AS record_notes, n AS record_products
       FROM lineitem JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) USING (l_partkey, l_suppkey)""",
)(lambda t: ingest_validate(*files_of(t))["output"])

query(
    "ingest_new_files",
    "SELECT l_orderkey AS file_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)(lambda t: ingest_validate(*files_of(t))["new_files"])

query(
    "ingest_validation",
    """SELECT l_orderkey AS file_id, count(*) AS record_count, max(l_linenumber) AS declared_count,
              CAST(count(*) = max(l_linenumber) AS INT) AS validation FROM lineitem GROUP BY l_orderkey""",
)(lambda t: ingest_validate(*files_of(t))["validation"])


def building(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_mktsegment") == "BUILDING")


query(
    "new_keys",
    "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)(lambda t: joins.new_keys(t.orders, building(t), "o_custkey", "c_custkey"))

query(
    "semi_join",
    "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)(lambda t: joins.semi_join(t.orders, building(t), ["o_custkey"], ["c_custkey"]))

query(
    "column_diff",
    """SELECT coalesce(o.column_name, l.column_name) AS "column",
        CASE WHEN o.column_name IS NULL THEN 'right' WHEN l.column_name IS NULL THEN 'left' ELSE 'both' END AS side
       FROM (DESCRIBE SELECT l_orderkey AS shared, * FROM lineitem) l
       FULL JOIN (DESCRIBE SELECT o_orderkey AS shared, * FROM orders) o USING (column_name)""",
)(
    lambda t: compare.column_diff(
        t.orders.withColumn("shared", F.col("o_orderkey")), t.lineitem.withColumn("shared", F.col("l_orderkey"))
    )
)

query(
    "key_metadata",
    """SELECT 's' || n_regionkey AS table_schema, 't' || n_nationkey AS table_name, n_name AS constraint_name,
        CASE WHEN n_nationkey % 2 = 0 THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS constraint_type,
        string_agg(s_name, ',' ORDER BY s_suppkey DESC) AS key_columns
       FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0 GROUP BY ALL""",
)(lambda t: _key_metadata(t))


def _key_metadata(t: Tables) -> DataFrame:
    """Nations stand for constraints and suppliers for their columns, ordered from the last to the first."""
    place = [F.concat(F.lit("s"), "n_regionkey").alias("table_schema"), F.concat(F.lit("t"), "n_nationkey").alias("table_name")]
    kind = F.when(F.col("n_nationkey") % 3 == 0, "CHECK").when(F.col("n_nationkey") % 2 == 0, "PRIMARY KEY").otherwise("UNIQUE")
    constraints = t.nation.select(F.col("n_name").alias("constraint_name"), *place, kind.alias("constraint_type"))
    columns = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("constraint_name"), *place, F.col("s_name").alias("column_name"), (-F.col("s_suppkey")).alias("ordinal_position")
    )
    return joins.key_columns(constraints, columns).withColumn("key_columns", F.array_join("key_columns", ","))


query(
    "literal_rows",
    "SELECT n_nationkey, label FROM nation JOIN (VALUES (0, 'near'), (3, 'far')) v(k, label) ON n_regionkey = k",
)(
    lambda t: t.nation.join(literal_df(t.spark, [(0, "near"), (3, "far")], "n_regionkey long, label string"), "n_regionkey").select(
        "n_nationkey", "label"
    )
)

query(
    "intersect_by_key",
    f"""WITH {SIDES} SELECT CAST(l.o_orderkey AS VARCHAR) AS o_orderkey, l.o_custkey AS left_o_custkey,
            r.o_custkey AS right_o_custkey, r.o_orderstatus AS right_o_orderstatus FROM l JOIN r USING (o_orderkey)""",
)(
    lambda t: joins.intersect_by_key(
        orders_left(t).select("o_orderkey", "o_custkey"),
        orders_right(t).select("o_orderkey", "o_custkey", "o_orderstatus"),
        ["o_orderkey"],
    )
)

query(
    "zero_stripped_join",
    r"""SELECT c_custkey, s_suppkey, c.code AS customer_code, s.code AS supplier_code
        FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS code FROM customer) c
        JOIN (SELECT s_suppkey, '00' || s_suppkey AS code FROM supplier) s
        ON regexp_replace(c.code, '^0+|0+$', '', 'g') = regexp_replace(s.code, '^0+|0+$', '', 'g')""",
)(
    lambda t: joins.join_zero_stripped(
        t.customer.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("customer_code")),
        t.supplier.select("s_suppkey", F.concat(F.lit("00"), F.col("s_suppkey")).alias("supplier_code")),
        "customer_code",
        "supplier_code",
    )
)


@query(
    "self_join_step",
    """SELECT DISTINCT a.c_custkey AS reportee_id, b.c_custkey // 4 AS manager_id
       FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey // 4""",
)
def self_join_step(t: Tables) -> DataFrame:
    edges = t.customer.select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_custkey") / 4).alias("mgr_id"))
    return joins.self_join_step(edges, edges.toDF("reportee_id", "manager_id"), "user_id", "mgr_id")


query(
    "sorted_keys",
    "SELECT l_suppkey, count(*) AS size FROM lineitem GROUP BY l_suppkey ORDER BY size DESC, l_suppkey",
)(lambda t: line_counts(t).orderBy(F.col("size").desc(), "l_suppkey"))


def landing(t: Tables) -> DataFrame:
    """Changes derived from all customers: updates, repeated keys, new keys, NULL keys."""
    key = F.col("c_custkey")
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    first = rows.filter(key % 3 == 0).select(key, F.concat("c_name", F.lit("-v1")).alias("c_name"), F.lit("EDITED").alias("c_mktsegment"), F.lit(1).alias("seq"))
    second = rows.filter(key % 6 == 0).select(key, F.concat("c_name", F.lit("-v2")), "c_mktsegment", F.lit(2))
    new = rows.filter(key % 5 == 0).select(key + 1_000_000_000, "c_name", F.lit("NEW"), F.lit(1))
    unkeyed = rows.filter(key % 50 == 0).select(F.lit(None).cast("long"), "c_name", F.lit("NOKEY"), F.lit(1))
    return first.unionAll(second).unionAll(new).unionAll(unkeyed)


LANDING = """src AS (SELECT c_custkey, c_name || '-v1' AS c_name, 'EDITED' AS c_mktsegment, 1 AS seq FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, c_name || '-v2', c_mktsegment, 2 FROM customer WHERE c_custkey % 6 = 0
    UNION ALL SELECT c_custkey + 1000000000, c_name, 'NEW', 1 FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT NULL, c_name, 'NOKEY', 1 FROM customer WHERE c_custkey % 50 = 0),
last AS (SELECT * FROM src WHERE c_custkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) = 1),
ins AS (SELECT c_custkey, c_name, NULL AS c_nationkey, NULL AS c_acctbal, c_mktsegment FROM last
            WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT c_custkey, c_name, NULL, NULL, c_mktsegment FROM src WHERE c_custkey IS NULL)"""


def _merged(name: str, segment: str) -> str:
    return f"""WITH {LANDING} SELECT c.c_custkey, {name} AS c_name, c_nationkey, c_acctbal, {segment} AS c_mktsegment
        FROM customer c LEFT JOIN last s ON c.c_custkey = s.c_custkey UNION ALL SELECT * FROM ins"""


_NEW_NAME = "CASE WHEN s.c_custkey IS NULL THEN c.c_name ELSE s.c_name END"
_NEW_SEGMENT = "CASE WHEN s.c_custkey IS NULL THEN c.c_mktsegment ELSE s.c_mktsegment END"

query("upsert", _merged(_NEW_NAME, "c.c_mktsegment"))(
    lambda t: maintain.upsert(t.customer, landing(t), ["c_custkey"], ["c_name"], ["seq"])
)
query("upsert_non_key", _merged(_NEW_NAME, _NEW_SEGMENT))(
    lambda t: maintain.upsert_non_key(t.customer, landing(t), ["c_custkey"], ["seq"])
)
query("upsert_touch", _merged("c.c_name", _NEW_SEGMENT))(
    lambda t: maintain.upsert_touch(t.customer, landing(t), ["c_custkey"], ["c_mktsegment"], ["seq"])
)
def bucketed_customers(t: Tables) -> DataFrame:
    """``customer`` as a table in buckets of its key."""
    name = f"customers_{uuid.uuid4().hex}"
    sinks.write_bucketed(t.customer, name, ["c_custkey"], 8, scratch_path(t.spark, name))
    return t.spark.table(name)


query("merge_full", _merged(_NEW_NAME, "c.c_mktsegment"))(
    lambda t: maintain.merge_full(bucketed_customers(t), landing(t), ["c_custkey"], ["c_name"], ["seq"])
)
query("merge_full_touch", _merged("c.c_name", _NEW_SEGMENT))(
    lambda t: maintain.merge_full(bucketed_customers(t), landing(t), ["c_custkey"], ["c_mktsegment"], ["seq"])
)
query("merge_full_non_key", _merged(_NEW_NAME, _NEW_SEGMENT))(
    lambda t: maintain.merge_full(
        bucketed_customers(t), landing(t), ["c_custkey"], [c for c in landing(t).columns if c in t.customer.columns and c != "c_custkey"], ["seq"]
    )
)
query(
    "replace",
    f"""WITH {LANDING} SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM last)
        UNION ALL SELECT c_custkey, c_name, NULL, NULL, c_mktsegment FROM last
        UNION ALL SELECT c_custkey, c_name, NULL, NULL, c_mktsegment FROM src WHERE c_custkey IS NULL""",
)(lambda t: maintain.replace(t.customer, landing(t), ["c_custkey"], ["seq"]))


def landed(t: Tables) -> DataFrame:
    """The landing side of a sync: all customers but some, so that deletes occur."""
    return t.customer.filter(F.col("c_custkey") % 10 != 3)


_KEYS = ["c_custkey", "c_nationkey"]
_AS_OF = datetime.date(2024, 1, 31)
_GONE = "SELECT *, DATE '2024-01-31' AS as_of_dt FROM customer WHERE c_custkey % 10 = 3"

query("anti_by_key", "SELECT * FROM customer WHERE c_custkey % 10 = 3")(
    lambda t: joins.anti_by_key(t.customer, landed(t), _KEYS)
)
query("deleted_rows", _GONE)(lambda t: maintain.deleted_rows(t.customer, landed(t), _KEYS, _AS_OF))
query("sync_deletes", "SELECT * FROM customer WHERE c_custkey % 10 <> 3")(
    lambda t: maintain.sync_deletes(t.customer, landed(t), _KEYS)
)
query("deleted_count", "SELECT count(*) AS deleted FROM customer WHERE c_custkey % 10 = 3")(
    lambda t: maintain.deleted_count(t.customer, landed(t), _KEYS)
)


@query(
    "sync_with_archive",
    f"""SELECT 'archive' AS part, * EXCLUDE (as_of_dt) FROM ({_GONE})
        UNION ALL SELECT 'kept', * FROM customer WHERE c_custkey % 10 <> 3""",
)
def sync_parts(t: Tables) -> DataFrame:
    gone, kept = sync_split(t.customer, landed(t), _KEYS, _AS_OF)
    return gone.drop("as_of_dt").select(F.lit("archive").alias("part"), "*").unionAll(
        kept.select(F.lit("kept").alias("part"), "*")
    )


query(
    "update_where",
    """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'OLD' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)(
    lambda t: clean.update_where(
        t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"),
        F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"),
        "o_orderstatus",
        F.lit("OLD"),
    ).drop("o_orderdate")
)


def line_counts(t: Tables) -> DataFrame:
    return count_by(t.lineitem, ["l_suppkey"], "size")


PACKED = """WITH RECURSIVE c AS (SELECT l_suppkey, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS i
    FROM lineitem GROUP BY l_suppkey),
cap AS (SELECT CAST(sum(size) AS BIGINT) // 20 AS capacity FROM c),
p AS (SELECT i, l_suppkey, size, 0 AS bin, size AS load FROM c WHERE i = 1
    UNION ALL SELECT c.i, c.l_suppkey, c.size, CASE WHEN p.load + c.size > capacity THEN p.bin + 1 ELSE p.bin END,
        CASE WHEN p.load + c.size > capacity THEN c.size ELSE p.load + c.size END
    FROM p JOIN c ON c.i = p.i + 1 JOIN cap ON true)"""

query("pack_keys", f"{PACKED} SELECT l_suppkey, size, bin FROM p")(
    lambda t: partition.pack_keys(line_counts(t), "l_suppkey", "size", 20)
)


@query(
    "assign_bins",
    f"{PACKED} SELECT bin, count(*) AS rows FROM lineitem JOIN p USING (l_suppkey) GROUP BY bin",
)
def assign_bins(t: Tables) -> DataFrame:
    bins = partition.pack_keys(line_counts(t), "l_suppkey", "size", 20)
    return count_by(partition.assign_bins(t.lineitem.select("l_suppkey"), bins, "l_suppkey"), ["bin"], "rows")


query(
    "choose_partitions",
    """SELECT count(*) AS rows, count(DISTINCT l_suppkey) AS distinct_keys,
              greatest(1, least(greatest(16, count(DISTINCT l_suppkey)), count(*) // 1000)) AS partitions FROM lineitem""",
)(lambda t: partition.choose_partitions(t.lineitem, "l_suppkey", 8, exact=True))

query(
    "choose_partitions_by_rows",
    "SELECT count(*) AS rows, greatest(10, least(count(*) // 1000000, 100)) AS partitions FROM lineitem",
)(lambda t: partition.choose_partitions_by_rows(t.lineitem))

query("repartition_bins", "SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY l_suppkey")(
    lambda t: count_by(partition.repartition_bins(t.lineitem.select("l_suppkey"), 8, "l_suppkey"), ["l_suppkey"], "rows")
)

query(
    "bins_in_one_partition",
    "SELECT l_suppkey % 40 AS bin, count(*) AS rows, CAST(1 AS BIGINT) AS partitions FROM lineitem GROUP BY ALL",
)(lambda t: _placement(partition.repartition_bins(t.lineitem.select((F.col("l_suppkey") % 40).alias("bin")), 8), "bin"))

query(
    "keys_in_one_partition",
    "SELECT l_suppkey, count(*) AS rows, CAST(1 AS BIGINT) AS partitions FROM lineitem GROUP BY ALL",
)(lambda t: _placement(partition.repartition_by(t.lineitem.select("l_suppkey"), 8, ["l_suppkey"]), "l_suppkey"))


def _placement(df: DataFrame, key: str) -> DataFrame:
    """Rows of every key, and the number of partitions they lie in."""
    placed = df.select(key, F.spark_partition_id().alias("_part"))
    return placed.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_part").alias("partitions"))


@query(
    "choose_partitions_sketched",
    """SELECT count(*) AS rows, true AS near, greatest(1, least(greatest(16, count(DISTINCT l_orderkey)), count(*) // 1000)) AS partitions,
        CAST(3 AS BIGINT) AS parts FROM lineitem""",
)
def choose_partitions_sketched(t: Tables) -> DataFrame:
    """Sizing from sketches kept per return flag, those of two thirds of the rows merged with the rest's."""
    first = t.lineitem.filter("l_linenumber % 3 <> 0")
    kept = partition.distinct_sketches(first, "l_orderkey", "l_returnflag")
    kept = partition.merge_sketches(kept, partition.distinct_sketches(t.lineitem.filter("l_linenumber % 3 = 0"), "l_orderkey", "l_returnflag"))
    chosen = partition.choose_partitions_from(kept, 8).withColumn("_all", F.lit(0))
    exact = t.lineitem.agg(F.count_distinct("l_orderkey").alias("exact"), F.count_distinct("l_returnflag").alias("parts")).withColumn("_all", F.lit(0))
    near = F.abs(F.col("distinct_keys") - F.col("exact")) <= F.lit(partition.SKETCH_ERROR) * F.col("exact") + 1
    return chosen.join(exact, "_all").select("rows", near.alias("near"), "partitions", "parts")


query(
    "column_metadata",
    """SELECT column_name AS "column", CASE WHEN column_type = 'BIGINT' THEN 'bigint' WHEN column_type = 'INTEGER' THEN 'int'
            WHEN column_type = 'DOUBLE' THEN 'double' WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'TIMESTAMP' THEN 'timestamp_ntz'
            ELSE lower(column_type) END AS type, "null" = 'YES' AS nullable, CAST(row_number() OVER () AS INTEGER) AS position FROM (DESCRIBE lineitem)""",
)(lambda t: clean.column_metadata(t.lineitem))
