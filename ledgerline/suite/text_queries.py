"""Cleaning, scalar functions, nested data and callbacks over the given tables."""

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions import callbacks, ledger, text
from ledgerline.functions.values import flag_eq
from ledgerline.operators import clean, nested
from ledgerline.operators.clean import CleanRules, TargetColumn
from ledgerline.plans.load import clean_rows
from ledgerline.plans.reports import run_query_list
from ledgerline.session import scratch_path
from ledgerline.sources.sinks import to_json_rows, union_by_name
from ledgerline.suite.quality_queries import GAPS, part_with_gaps
from ledgerline.suite.registry import Tables, query

query("scrub_documents", r"SELECT doc_id, regexp_replace(text, '[^\w\s-]', '', 'g') AS text FROM documents")(
    lambda t: clean.scrub_text(t.documents.select("doc_id", "text"))
)

TWO_RULES = CleanRules(rules=[(text.DELIMITER_CHARS, " ")])
query(
    "scrub_rules",
    r"""SELECT page_id, regexp_replace(regexp_replace(html, '[~^]', ' ', 'g'), '[^\w\s-]', '', 'g') AS html FROM pages""",
)(lambda t: clean.scrub_text(t.pages.select("page_id", "html"), TWO_RULES))

query(
    "fill_nulls",
    f"""WITH {GAPS} SELECT p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_brand, '') AS p_brand,
        coalesce(p_type, '') AS p_type, p_size FROM part_with_gaps""",
)(lambda t: clean.fill_null_text(part_with_gaps(t)))

query(
    "fill_nulls_as_text",
    f"""WITH {GAPS} SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_brand, '') AS p_brand,
        coalesce(p_type, '') AS p_type, coalesce(CAST(p_size AS VARCHAR), '') AS p_size FROM part_with_gaps""",
)(lambda t: clean.fill_null_text(part_with_gaps(t), as_text=True))

query(
    "normalise_types",
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(12,2)) AS DOUBLE) AS l_quantity, l_tax FROM lineitem",
)(
    lambda t: clean.normalise_types(
        t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(12,2)"), "l_tax")
    )
)

ORDER_TARGET = [
    TargetColumn("o_orderkey", "bigint", nullable=False),
    TargetColumn("o_custkey", "INT(11)", nullable=False),
    TargetColumn("o_orderdate", "datetime"),
    TargetColumn("o_note", "varchar(20)"),
    TargetColumn("o_orderpriority", "varchar(20)"),
    TargetColumn("last_login", "varchar(20)"),
]


def order_extract(t: Tables) -> DataFrame:
    """Orders as text columns, as an extract delivers them; some dates are not dates."""
    return t.orders.select(
        F.col("o_orderpriority"),
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.when(F.col("o_orderkey") % 19 == 0, F.lit("n/a"))
        .otherwise(F.col("o_orderdate").cast("string"))
        .alias("o_orderdate"),
        F.concat(F.lit("a^b~c! "), "o_orderstatus", F.lit("-é")).alias("o_note"),
        F.lit("unused").alias("extra"),
    )


_DATE_SQL = "CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS VARCHAR) END"


@query(
    "cast_by_types",
    f"""SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, {_DATE_SQL} AS o_orderdate,
        'a^b~c! ' || o_orderstatus || '-é' AS o_note, o_orderpriority, CAST(NULL AS VARCHAR) AS last_login FROM orders""",
)
def cast_by_types(t: Tables) -> DataFrame:
    typed = clean.cast_by_types(clean.conform_schema(order_extract(t), ORDER_TARGET, ["last_login"]), ORDER_TARGET)
    return typed.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    "clean_rows",
    f"""SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, {_DATE_SQL} AS o_orderdate,
        'a b c ' || o_orderstatus || '-' AS o_note, o_orderpriority, '' AS last_login FROM orders""",
)
def cleaned(t: Tables) -> DataFrame:
    rows = clean_rows(order_extract(t), ORDER_TARGET, ["last_login"], TWO_RULES)
    return rows.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


query(
    "stamp",
    "SELECT n_nationkey, DATE '2024-01-31' AS load_date, o_orderkey FROM orders JOIN nation ON n_nationkey = o_custkey % 25",
)(
    lambda t: clean.stamp(
        t.orders.join(t.nation, F.col("o_custkey") % 25 == F.col("n_nationkey")).select("n_nationkey", "o_orderkey"),
        "load_date",
        __import__("datetime").date(2024, 1, 31),
    )
)

query("flag_eq", "SELECT l_orderkey, CAST(l_quantity = l_linenumber AS INT) AS same FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", flag_eq(F.col("l_quantity"), F.col("l_linenumber")).alias("same"))
)

query(
    "gate_contains",
    """SELECT event_id, CASE WHEN contains(props, '"k": 1') THEN props ELSE '[]' END AS gated FROM events""",
)(lambda t: t.events.select("event_id", text.keep_if_contains(F.col("props"), '"k": 1').alias("gated")))


def addresses(t: Tables) -> DataFrame:
    kind = F.col("c_custkey") % 5
    address = (
        F.when(kind == 0, F.concat("c_name", F.lit("@example.com")))
        .when(kind == 1, F.concat(F.lit("user."), F.col("c_custkey"), F.lit("@mail.example.com")))
        .when(kind == 2, F.lit("a..b@x.com"))
        .when(kind == 3, F.lit(""))
    )
    return t.customer.select("c_custkey", address.alias("address"))


query(
    "email_valid",
    f"""SELECT c_custkey, coalesce(regexp_full_match(address, '{text.EMAIL}'), false) AS valid FROM (
        SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || '@example.com'
            WHEN 1 THEN 'user.' || c_custkey || '@mail.example.com' WHEN 2 THEN 'a..b@x.com' WHEN 3 THEN '' END AS address
        FROM customer)""",
)(lambda t: addresses(t).select("c_custkey", text.is_email(F.col("address")).alias("valid")))

query(
    "email_tokens",
    rf"""SELECT doc_id, count(*) AS emails FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS token
        FROM documents) WHERE regexp_full_match(token, '{text.EMAIL}') GROUP BY doc_id""",
)(
    lambda t: t.documents.select("doc_id", F.explode(F.split("text", r"[ \t\n\r]+")).alias("token"))
    .filter(text.is_email(F.col("token")))
    .groupBy("doc_id")
    .agg(F.count(F.lit(1)).alias("emails"))
)

query(
    "id_shape",
    rf"""SELECT p_partkey, nullif(regexp_extract(id, '{text.ID_SHAPE}', 0), '') AS shape FROM (SELECT p_partkey,
        CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' - ABC-' || p_partkey || '-' || p_size || '-XYZ' END AS id FROM part)""",
)(
    lambda t: t.part.select(
        "p_partkey",
        text.id_shape(
            F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(
                F.concat("p_name", F.lit(" - ABC-"), "p_partkey", F.lit("-"), "p_size", F.lit("-XYZ"))
            )
        ).alias("shape"),
    )
)

query(
    "id_prefix",
    """SELECT o_orderkey, CASE WHEN regexp_matches(id, '-[^-]*-[^-]*$') THEN regexp_replace(id, '-[^-]*-[^-]*$', '') END AS prefix
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority
             ELSE o_orderkey || '-' || o_orderpriority || '-' || o_orderstatus END AS id FROM orders)""",
)(
    lambda t: t.orders.select(
        "o_orderkey",
        text.id_prefix(
            F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(
                F.concat_ws("-", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus")
            )
        ).alias("prefix"),
    )
)


def responses(t: Tables) -> DataFrame:
    body = F.concat(
        F.lit("name: "), "c_name", F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit(", version: '1."), F.col("c_nationkey"), F.lit("', ok"))).otherwise("")
    )
    return t.customer.select("c_custkey", body.alias("body"))


query(
    "version_check",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN '1.' || c_nationkey END AS version,
              c_custkey % 4 <> 0 AND c_nationkey = 3 AS expected FROM customer""",
)(
    lambda t: responses(t).select(
        "c_custkey", text.version_of(F.col("body")).alias("version"), text.version_is(F.col("body"), "1.3").alias("expected")
    )
)

query(
    "url_parts",
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
        replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', '_') AS name FROM pages""",
)(
    lambda t: t.pages.select(
        "page_id",
        F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"),
        F.try_parse_url("url", F.lit("HOST")).alias("host"),
        text.path_as_name(F.try_parse_url("url", F.lit("PATH"))).alias("name"),
    )
)

query("nest_explode", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")(
    lambda t: nested.unnest_rows(
        nested.nest_rows(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_mktsegment", 100)
    )
)

query(
    "nest_counts",
    "SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY l_suppkey",
)(
    lambda t: nested.nest_rows(t.lineitem.select("l_suppkey", "l_returnflag", "l_linenumber"), "l_suppkey", 100_000)
    .select("l_suppkey", F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["copies"]).alias("n"))
    .groupBy("l_suppkey")
    .agg(F.sum("n").alias("rows"))
)

query(
    "names_per_key",
    """SELECT p_type, CAST(0 AS BIGINT) AS piece, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY p_type""",
)(lambda t: nested.distinct_values(t.part, ["p_type"], "p_brand", 100_000).select("p_type", "piece", F.array_join("values", ",").alias("brands")))

query(
    "names_in_pieces",
    """WITH d AS (SELECT DISTINCT c_mktsegment, c_name FROM customer),
       n AS (SELECT c_mktsegment, count(*) AS n FROM d GROUP BY c_mktsegment)
       SELECT c_mktsegment, CASE WHEN n > 50 THEN CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) % CAST(ceil(n / 50.0) AS BIGINT)
            ELSE 0 END AS piece, string_agg(c_name, ',' ORDER BY c_name) AS names FROM d JOIN n USING (c_mktsegment) GROUP BY ALL""",
)(
    lambda t: nested.distinct_values(t.customer, ["c_mktsegment"], "c_name", 50).select(
        "c_mktsegment", "piece", F.array_join("values", ",").alias("names")
    )
)

query(
    "array_agg_distinct",
    """SELECT p_brand, CAST(0 AS BIGINT) AS piece, string_agg(DISTINCT word, ',' ORDER BY word) AS words
       FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY p_brand""",
)(
    lambda t: nested.distinct_elements(t.part, ["p_brand"], F.split("p_name", " "), 100_000, name="words").select(
        "p_brand", "piece", F.array_join("words", ",").alias("words")
    )
)

query(
    "string_agg",
    """SELECT c_nationkey, (rn - 1) // 20 AS piece, string_agg(c_name, ';' ORDER BY rn) AS text FROM (
        SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS rn FROM customer) GROUP BY ALL""",
)(lambda t: nested.joined_text(t.customer, ["c_nationkey"], "c_name", 20, ";"))


def listed_segments(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_acctbal") > 8500).select("c_nationkey", "c_mktsegment")


query(
    "distinct_items",
    """SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS position, c_mktsegment
       FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 8500)""",
)(lambda t: nested.distinct_items(listed_segments(t), ["c_nationkey"], "c_mktsegment"))

query(
    "enrich_keeps_values",
    """SELECT o_orderkey + 9007199254740993 AS big, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 9007199254740993 END AS gaps,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS day, o_orderkey % 3 = 0 AS missing FROM orders""",
)(
    lambda t: callbacks.enrich(
        t.orders.select(
            (F.col("o_orderkey") + 9007199254740993).alias("big"),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") + 9007199254740993).alias("gaps"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("day"),
        ),
        lambda record: record["gaps"] is None,
        "missing",
        "boolean",
    )
)

query(
    "conflicts",
    """WITH listed AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 8500),
       lists AS (SELECT c_nationkey, string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment) AS names FROM listed GROUP BY c_nationkey)
       SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM listed)
            THEN 'No Conflict' ELSE 'Conflict with ' || coalesce(names, '') END AS conflict
       FROM customer LEFT JOIN lists USING (c_nationkey)""",
)(
    lambda t: nested.name_conflicts(
        t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment", listed_segments(t), with_text=True
    )
)


def order_cells(t: Tables) -> DataFrame:
    """Orders as cells: the row is the customer, the column the priority, later orders win."""
    return t.orders.select(
        F.col("o_custkey").cast("string").alias("row_key"),
        F.lit("orders").alias("family"),
        F.col("o_orderpriority").alias("qualifier"),
        F.col("o_orderkey").cast("string").alias("value"),
        F.col("o_orderkey").alias("written"),
    )


query(
    "cells_to_json",
    """SELECT row_key, CAST(0 AS BIGINT) AS piece, '{' || string_agg('"orders:' || o_orderpriority || '":"' || v || '"', ',' ORDER BY o_orderpriority) || '}' AS json
       FROM (SELECT CAST(o_custkey AS VARCHAR) AS row_key, o_orderpriority, max(o_orderkey) AS v FROM orders GROUP BY ALL) GROUP BY row_key""",
)(lambda t: nested.cells_to_json(order_cells(t), "written", 100_000))

query(
    "row_cells",
    "SELECT '7' AS row_key, o_orderpriority AS qualifier, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_custkey = 7",
)(lambda t: nested.row_cells(order_cells(t), "7").select("row_key", "qualifier", "value"))

query(
    "rows_to_json",
    """SELECT CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}) AS VARCHAR) AS json FROM customer""",
)(lambda t: to_json_rows(t.customer.select("c_custkey", "c_name", "c_mktsegment")))

query(
    "json_props",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""",
)(lambda t: t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k")))


def people(t: Tables) -> DataFrame:
    """A JSON array of people per event: two, one, none, or text that is not JSON."""
    age = F.col("event_id") % 90
    john = F.concat(F.lit('{"name": "John", "age": '), age, F.lit(', "dob": "1992-01-15"}'))
    darth = F.concat(F.lit('{"name": "Darth", "age": '), age + 1, F.lit(', "dob": "1982-05-25"}'))
    kind = F.col("event_id") % 4
    array = (
        F.when(kind == 0, F.concat(F.lit("["), john, F.lit(", "), darth, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("["), darth, F.lit("]")))
        .when(kind == 2, F.lit("[]"))
        .otherwise(F.lit("not json"))
    )
    return t.events.select("event_id", array.alias("json_data"))


query(
    "json_names",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 90 AS INT) END AS John_age,
        CASE WHEN event_id % 4 = 0 THEN DATE '1992-01-15' END AS John_dob,
        CASE WHEN event_id % 4 <= 1 THEN CAST(event_id % 90 + 1 AS INT) END AS Darth_age,
        CASE WHEN event_id % 4 <= 1 THEN DATE '1982-05-25' END AS Darth_dob FROM events""",
)(lambda t: nested.named_attributes(people(t), "json_data", ["John", "Darth"]))

query(
    "union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)(
    lambda t: union_by_name(
        [
            t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
            t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        ]
    )
)

query(
    "union_all",
    "SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier",
)(lambda t: t.customer.select(F.col("c_custkey").alias("id")).unionAll(t.supplier.select("s_suppkey")))

_STATUS_COUNT = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
_SEGMENT_COUNT = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"


@query(
    "run_query_list",
    f"""SELECT 1 AS query_no, CAST(to_json({{'o_orderstatus': o_orderstatus, 'n': n}}) AS VARCHAR) AS row FROM ({_STATUS_COUNT})
        UNION ALL SELECT 2, CAST(to_json({{'c_mktsegment': c_mktsegment, 'n': n}}) AS VARCHAR) FROM ({_SEGMENT_COUNT})""",
)
def query_list(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    t.customer.createOrReplaceTempView("customer")
    return run_query_list(t.spark, [_STATUS_COUNT + ";", _SEGMENT_COUNT]).select("query_no", "row")


def _label(record: dict) -> str:
    return f"{record['c_mktsegment']}/{record['c_custkey']}"


query("enrich", "SELECT c_custkey, c_mktsegment, c_mktsegment || '/' || c_custkey AS response FROM customer")(
    lambda t: callbacks.enrich(t.customer.select("c_custkey", "c_mktsegment"), _label, "response")
)

def _doubled(rows):
    import pyarrow.compute as pc

    return rows.append_column("doubled", pc.multiply(rows["l_quantity"], 2.0)).select(["l_orderkey", "doubled"])


query("apply_partitions", "SELECT l_orderkey, l_quantity * 2 AS doubled FROM lineitem")(
    lambda t: callbacks.apply_partitions(
        t.lineitem.select("l_orderkey", "l_quantity"),
        _doubled,
        "l_orderkey long, doubled double",
    )
)


@query("enriched_once", "SELECT o_orderkey, 'customer ' || o_custkey AS label FROM orders")
def enriched_once(t: Tables) -> DataFrame:
    """Orders with a response per customer, asked once each."""
    asked = t.orders.select("o_orderkey", "o_custkey")
    found = ledger.enrich_once(asked, ["o_custkey"], lambda key: f"customer {key['o_custkey']}", "label", scratch_path(t.spark, "ledger"))
    return found.select("o_orderkey", "label")
