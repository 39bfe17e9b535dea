"""Files, logs, graphs and messages derived from the given tables by Spark."""

import datetime
import uuid

from pyspark.sql import DataFrame, functions as F

from ledgerline.operators import graph, intervals, logs
from ledgerline.operators.clean import TargetColumn
from ledgerline.operators.maintain import upsert
from ledgerline.operators.rows import global_rank, carry_forward
from ledgerline.plans import load
from ledgerline.plans.load import SyncTable, clean_for_load, load_and_upsert
from ledgerline.plans.reports import top_load_times
from ledgerline.session import materialize, scratch_path
from ledgerline.sources import files, sinks, transactions
from ledgerline.streaming import messages
from ledgerline.suite.registry import Tables, query

# --- delimited files -------------------------------------------------------

_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"
_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"


def customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("csv_round_trip", _CUSTOMER_SQL)
def csv_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    sinks.export_csv(customers(t), path)
    return files.read_csv(t.spark, path, schema=_CUSTOMER)


@query("csv_unquoted", _CUSTOMER_SQL)
def csv_unquoted(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    sinks.export_csv(customers(t), path, quoted=False)
    return files.read_csv_dir(t.spark, path, _CUSTOMER)


@query("tsv_inferred", "SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def tsv_inferred(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "tsv")
    customers(t).write.csv(path, sep="\t", header=True)
    return files.read_tsv(t.spark, path)


@query("single_csv", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def single_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "single")
    sinks.export_single_csv(t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), path)
    return files.read_csv(t.spark, path, schema="c_mktsegment string, n long")


_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
_HARD_SQL = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 <> 0 THEN
        ' "' || text || chr(10) || '|^,' || chr(13) || chr(92) || 'N' || chr(92) || chr(9) || ' ' END AS text,
    CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source,
    CASE WHEN doc_id % 13 <> 0 THEN n_chars END AS n_chars FROM documents"""


def hard_documents(t: Tables) -> DataFrame:
    """All documents, with quotes, separators, line breaks, backslashes, outer spaces, empty texts and NULLs."""
    key = F.col("doc_id")
    text = F.concat(F.lit(' "'), "text", F.lit("\n|^,\r\\N\\\t "))
    return t.documents.select(
        "doc_id",
        F.when(key % 7 == 0, F.lit("")).when(key % 11 != 0, text).alias("text"),
        F.when(key % 5 != 0, F.col("lang")).alias("lang"),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("source"),
        F.when(key % 13 != 0, F.col("n_chars")).alias("n_chars"),
    )


@query("csv_documents", _HARD_SQL)
def csv_documents(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    sinks.export_csv(hard_documents(t), path)
    return files.read_own_csv(t.spark, path, _DOCUMENTS)


@query("single_csv_documents", _HARD_SQL)
def single_csv_documents(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "single")
    sinks.export_single_csv(hard_documents(t), path)
    return files.read_own_csv(t.spark, path, _DOCUMENTS)


@query("delimited_documents", _HARD_SQL)
def delimited_documents(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "caret")
    sinks.export_delimited(hard_documents(t), path, "^", "\\N")
    return files.import_delimited(t.spark, path, _DOCUMENTS, "^", nullif_empty=False, null_token="\\N")


def faulty_customers(t: Tables) -> str:
    """Customers as part files with bad numbers, bad and missing keys, and lines of too few fields; the folder."""
    path = scratch_path(t.spark, "faulty")
    key = F.col("c_custkey")
    text = key.cast("string")
    line = (
        F.when(key % 10 == 1, F.concat_ws("^", text, F.lit("new"), F.lit("many"), F.lit("x")))
        .when(key % 10 == 2, F.concat_ws("^", F.lit("bad"), F.lit("new"), F.lit("1"), F.lit("x")))
        .when(key % 10 == 3, F.concat_ws("^", F.lit(""), F.lit("new"), F.lit("1"), F.lit("x")))
        .when(key % 10 == 4, F.concat_ws("^", text, F.lit("new")))
        .otherwise(F.concat_ws("^", text, F.lit("new"), F.lit("1"), F.lit("x")))
    )
    t.customer.select(line.alias("value")).write.text(path)
    return path


query(
    "load_with_rejects",
    """SELECT c_custkey, CASE WHEN c_custkey % 10 IN (1, 2, 3, 4) THEN c_name ELSE 'new' END AS c_name,
        CASE WHEN c_custkey % 10 IN (1, 2, 3, 4) THEN c_nationkey ELSE 1 END AS c_nationkey,
        CASE WHEN c_custkey % 10 IN (1, 2, 3, 4) THEN c_mktsegment ELSE 'x' END AS c_mktsegment FROM customer""",
)(lambda t: load_and_upsert(t.spark, faulty_customers(t), customers(t).withColumn("c_nationkey", F.col("c_nationkey").cast("int")), ["c_custkey"]).state)

query(
    "load_rejects",
    """SELECT CASE c_custkey % 10 WHEN 1 THEN 'value of c_nationkey' WHEN 2 THEN 'value of c_custkey' WHEN 3 THEN 'no c_custkey'
            ELSE 'fields: 2 instead of 4' END AS error, count(*) AS lines FROM customer WHERE c_custkey % 10 IN (1, 2, 3, 4) GROUP BY 1""",
)(
    lambda t: load_and_upsert(t.spark, faulty_customers(t), customers(t), ["c_custkey"])
    .rejects.groupBy(F.col("_error").alias("error"))
    .agg(F.count(F.lit(1)).alias("lines"))
)

query(
    "load_totals",
    """SELECT count(*) FILTER (c_custkey % 10 NOT IN (1, 2, 3, 4)) AS rows_loaded, count(*) FILTER (c_custkey % 10 IN (1, 2, 3, 4)) AS rows_rejected
       FROM customer""",
)(lambda t: _load_totals(load_and_upsert(t.spark, faulty_customers(t), customers(t), ["c_custkey"])))


def _load_totals(result) -> DataFrame:
    rejected = result.rejects.agg(F.count(F.lit(1)).alias("rows_rejected"))
    both = result.totals.select("rows_loaded", F.lit(None).cast("long").alias("rows_rejected")).unionByName(
        rejected.select(F.lit(None).cast("long").alias("rows_loaded"), "rows_rejected")
    )
    return both.agg(F.max("rows_loaded").alias("rows_loaded"), F.max("rows_rejected").alias("rows_rejected"))


@query(
    "staged_merge",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders
       UNION ALL SELECT o_orderkey + 1000000000, 'new' FROM orders WHERE o_orderkey % 8 = 1""",
)
def staged_merge(t: Tables) -> DataFrame:
    """Changes are staged and merged into a saved table, which is then read and dropped."""
    name = f"merged_{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    base = t.orders.select("o_orderkey", "o_orderstatus")
    new = base.filter(key % 4 == 1).withColumn("o_orderstatus", F.lit("new"))
    added = new.filter(key % 8 == 1).withColumn("o_orderkey", key + 1_000_000_000)
    try:
        sinks.save_table(base, name, "overwrite")
        sinks.staged_merge(new.unionAll(added), lambda s: upsert(t.spark.table(name), s, ["o_orderkey"]), name)
        return materialize(t.spark.table(name), "merged")
    finally:
        t.spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(
    "sync_archive_tables",
    """SELECT 'archived' AS state, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 5 = 0
       UNION ALL SELECT 'kept', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 5 <> 0""",
)
def sync_archive_tables(t: Tables) -> DataFrame:
    """Catalog tables are made for the run, synchronised twice, summed up and dropped."""
    name = f"sync_{uuid.uuid4().hex}"
    table = SyncTable(f"{name}_prod", f"{name}_landing", f"{name}_archive", ["o_orderkey"])
    try:
        sinks.save_table(t.orders.select("o_orderkey", "o_orderstatus"), table.prod, "overwrite")
        sinks.save_table(t.orders.filter("o_orderkey % 5 <> 0").select("o_orderkey"), table.landing, "overwrite")
        for _ in range(2):
            load.sync_with_archive(t.spark, [table], datetime.date(2024, 1, 31))
        parts = [
            t.spark.table(n).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")).select(F.lit(s).alias("state"), "rows", "keys")
            for s, n in (("archived", table.archive), ("kept", table.prod))
        ]
        return materialize(parts[0].unionByName(parts[1]), "synced")
    finally:
        for n in (table.prod, table.landing, table.archive):
            t.spark.sql(f"DROP TABLE IF EXISTS {n}")


def sparse_customers(t: Tables) -> DataFrame:
    return customers(t).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))


_SPARSE_SQL = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer"


@query("delimited_round_trip", _SPARSE_SQL)
def delimited_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "pipe")
    sinks.export_delimited(sparse_customers(t), path, "|")
    return files.import_delimited(t.spark, path, _CUSTOMER, "|")


@query("delimited_null_token", _SPARSE_SQL)
def delimited_null_token(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "caret")
    sinks.export_delimited(sparse_customers(t), path, "^", "NULL")
    return files.import_delimited(t.spark, path, _CUSTOMER, "^", null_token="NULL")


@query(
    "parquet_round_trip",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
)
def parquet_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "parquet")
    sinks.write_parquet(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return t.spark.read.parquet(path)


@query("append", "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT s_suppkey, s_suppkey FROM supplier")
def append(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "append")
    sinks.write_parquet(t.orders.select("o_orderkey", "o_custkey"), path)
    key = F.col("s_suppkey")
    sinks.write_parquet(t.supplier.select(key.alias("o_orderkey"), key.alias("o_custkey")), path, "append")
    return t.spark.read.parquet(path)


class CountingSink:
    """A sink that keeps nothing; stands in for a database connection."""

    pending = 0

    def write(self, batch):
        self.pending = batch.num_rows

    def commit(self):
        self.pending = 0

    def rollback(self):
        self.pending = 0

    def close(self):
        assert self.pending == 0


query("write_partitions", "SELECT CAST(count(*) AS BIGINT) AS rows FROM lineitem")(
    lambda t: sinks.write_partitions(t.lineitem.select("l_orderkey", "l_linenumber"), CountingSink, 1000).agg(
        F.sum("rows").alias("rows")
    )
)


@query("transactional_batches", "SELECT * FROM lineitem")
def transactional_batches(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "batches")
    job = transactions.write_transactional(t.lineitem, transactions.FolderTarget(path))
    return transactions.read_job(t.spark, path, job, t.lineitem.schema)


@query("transactional_receipts", "SELECT count(*) AS rows, CAST(count(*) AS BIGINT) AS receipted FROM lineitem")
def transactional_receipts(t: Tables) -> DataFrame:
    """Rows that the published job holds, beside those its receipts name; the table's own splits are the partitions."""
    path = scratch_path(t.spark, "batches")
    job = transactions.write_transactional(t.lineitem, transactions.FolderTarget(path), 1000)
    named = transactions.receipts(t.spark, path, job).agg(F.sum("rows").alias("receipted"))
    return transactions.read_job(t.spark, path, job, t.lineitem.schema).agg(F.count(F.lit(1)).alias("rows")).join(named)


@query(
    "run_dated",
    "SELECT '01312024' AS run_date, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
)
def run_dated(t: Tables) -> DataFrame:
    import datetime

    path = scratch_path(t.spark, "dated")
    sinks.write_run_dated(t.orders.select("o_orderstatus"), path, datetime.date(2024, 1, 31))
    stored = t.spark.read.schema("o_orderstatus string, run_date string").parquet(path)
    return stored.groupBy("run_date", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "list_outputs",
    """SELECT c_nationkey, 1 AS files, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS length FROM customer GROUP BY c_nationkey""",
)
def list_outputs(t: Tables) -> DataFrame:
    """One text file per nation, with its size."""
    path = scratch_path(t.spark, "outputs")
    t.customer.select("c_name", "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("c_nationkey")
    found = files.list_outputs(t.spark, path).groupBy(nation)
    return found.agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("length").alias("length"))


@query(
    "load_ledger",
    """SELECT 'c_nationkey=' || c_nationkey AS file, count(*) FILTER (c_custkey % 9 <> 0 OR c_nationkey % 2 = 1) AS rows_loaded,
        count(*) FILTER (c_custkey % 9 = 0 AND c_nationkey % 2 = 0) AS bad_rows,
        CASE WHEN count(*) FILTER (c_custkey % 9 = 0 AND c_nationkey % 2 = 0) = 0 THEN 'loaded'
             WHEN count(*) FILTER (c_custkey % 9 <> 0 OR c_nationkey % 2 = 1) = 0 THEN 'failed' ELSE 'partial' END AS status
        FROM customer GROUP BY c_nationkey""",
)
def load_ledger(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ledger")
    bad = (F.col("c_custkey") % 9 == 0) & (F.col("c_nationkey") % 2 == 0)
    key = F.when(bad, F.lit("bad")).otherwise(F.col("c_custkey").cast("string"))
    (
        t.customer.select(F.concat_ws("|", key, "c_name").alias("value"), "c_nationkey")
        .write.partitionBy("c_nationkey")
        .text(path)
    )
    ledger = files.load_ledger(t.spark, path, "c_custkey long, c_name string")
    folder = F.regexp_extract("file", r"(c_nationkey=\d+)", 1)
    loaded, failed = F.sum("rows_loaded"), F.sum("bad_rows")
    return ledger.groupBy(folder.alias("file")).agg(
        loaded.alias("rows_loaded"),
        failed.alias("bad_rows"),
        F.when(failed == 0, F.lit("loaded")).when(loaded == 0, F.lit("failed")).otherwise(F.lit("partial")).alias("status"),
    )


@query(
    "keyed_csvs",
    """SELECT c_mktsegment AS source_key, count(*) AS rows, NULL::VARCHAR AS error FROM customer GROUP BY c_mktsegment
       UNION ALL SELECT 'ABSENT', 0, 'missing'""",
)
def keyed_csvs(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "keyed")
    customers(t).write.partitionBy("c_mktsegment").csv(path, header=True)
    keys = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "ABSENT"]
    return files.read_keyed_csvs(t.spark, path + "/c_mktsegment={key}", keys, ["c_custkey"])[1]


@query(
    "keyed_csv_rows",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'n' ELSE '' END || c_nationkey AS c_nationkey,
        c_mktsegment AS source_key FROM customer""",
)
def keyed_csv_rows(t: Tables) -> DataFrame:
    """Nations are numbers in all sources but one, so they are text in the whole."""
    path = scratch_path(t.spark, "keyed")
    nation = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", F.lit("n")).otherwise(F.lit("")), "c_nationkey")
    customers(t).withColumn("c_nationkey", nation).write.partitionBy("c_mktsegment").csv(path, header=True)
    keys = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return files.read_keyed_csvs(t.spark, path + "/c_mktsegment={key}", keys, ["c_custkey"])[0]


@query(
    "source_status",
    """SELECT 'r' || r_regionkey AS source_key, count(n_nationkey) > 0 AS success, count(c_custkey) AS rows,
        CASE WHEN count(c_custkey) = 0 THEN 'no rows' END AS error FROM (SELECT r_regionkey FROM region UNION ALL SELECT 99)
        LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey""",
)
def source_status(t: Tables) -> DataFrame:
    expected = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("source_key")).unionAll(
        t.spark.createDataFrame([("r99",)], "source_key string")
    )
    nations = t.nation.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("source_key"))
    rows = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("source_key")
    return files.source_status(expected, rows)


@query(
    "url_list",
    """SELECT url, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '' ELSE 'id_' || page_id END AS id_column,
        CASE WHEN page_id % 5 = 0 THEN 'no comma' WHEN page_id % 7 = 0 THEN 'missing id column' END AS error
       FROM (SELECT page_id, replace(url, ',', '%2C') AS url FROM pages)""",
)
def url_list(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "urls")
    key, url = F.col("page_id"), F.replace("url", F.lit(","), F.lit("%2C"))
    line = (
        F.when(key % 5 == 0, url)
        .when(key % 7 == 0, F.concat(url, F.lit(",")))
        .otherwise(F.concat(url, F.lit(",id_"), key))
    )
    t.pages.select(line.alias("value")).write.text(path)
    return files.read_url_list(t.spark, path, strict=False)


@query(
    "clean_and_upsert",
    """SELECT c_custkey, regexp_replace(c_name, '[^\\w\\s-]', '', 'g') AS c_name, c_nationkey, c_mktsegment FROM customer
       WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1""",
)
def clean_and_upsert(t: Tables) -> DataFrame:
    """Half of the customers are extracted, cleaned, exported, imported and merged."""
    target = [
        TargetColumn("c_custkey", "bigint", nullable=False),
        TargetColumn("c_name", "varchar(40)"),
        TargetColumn("c_nationkey", "int"),
        TargetColumn("c_mktsegment", "varchar(20)"),
    ]
    path = scratch_path(t.spark, "load")
    clean_for_load(customers(t).filter(F.col("c_custkey") % 2 == 0), target, path)
    return load_and_upsert(t.spark, path, customers(t), ["c_custkey"]).state


# --- numbered lines --------------------------------------------------------

#: lines per file of the feed written below
FEED_LINES = 100


def write_feed(t: Tables) -> str:
    """Documents as tab-separated lines in files of ``FEED_LINES`` lines; returns the folder."""
    path = scratch_path(t.spark, "feed")
    key = F.col("doc_id")
    line = F.concat_ws(
        "\t",
        key.cast("string"),
        F.when(F.col("n_chars") % 3 == 0, F.lit("")).otherwise(F.col("lang")),
        F.when(F.col("n_chars") % 2 == 0, F.lit("")).otherwise(F.lit("x")),
        "source",
        F.col("n_chars").cast("string"),
        F.when(F.col("n_chars") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("token"), key)),
    )
    feed = t.documents.select(line.alias("value"), F.floor(key / FEED_LINES).alias("file"), "doc_id")
    (
        feed.repartition("file")
        .sortWithinPartitions("file", "doc_id")
        .select("value", "file")
        .write.partitionBy("file")
        .text(path)
    )
    return path


def feed_lines(t: Tables) -> DataFrame:
    return files.numbered_lines(t.spark, write_feed(t))


def _file_no(path: str = "path"):
    return F.regexp_extract(path, r"file=(\d+)", 1).cast("long")


FEED = f"""feed AS (SELECT doc_id // {FEED_LINES} AS file, row_number() OVER (PARTITION BY doc_id // {FEED_LINES} ORDER BY doc_id) AS line_no,
    doc_id, n_chars, source, CASE WHEN n_chars % 3 = 0 THEN '' ELSE lang END AS f2, CASE WHEN n_chars % 2 = 0 THEN '' ELSE 'x' END AS f3,
    CASE WHEN n_chars % 5 = 0 THEN '' ELSE 'token' || doc_id END AS f6 FROM documents)"""

query("numbered_lines", f"WITH {FEED} SELECT file, line_no, doc_id FROM feed")(
    lambda t: feed_lines(t).select(_file_no().alias("file"), "line_no", files.nth_field(F.col("line"), 1).cast("long").alias("doc_id"))
)

query(
    "file_header_scan",
    f"""WITH {FEED} SELECT file, source AS key, CAST(f2 = '' AS INT) + CAST(f3 = '' AS INT) + CAST(f6 = '' AS INT) AS empty_fields
        FROM feed WHERE line_no = 2""",
)(lambda t: files.file_header_scan(files.first_lines(t.spark, write_feed(t), 2)).select(_file_no().alias("file"), "key", "empty_fields"))

query(
    "tail_lines",
    f"""WITH {FEED} SELECT file, line_no, doc_id FROM feed QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no DESC) <= 5""",
)(
    lambda t: files.last_lines(t.spark, write_feed(t)).select(
        _file_no().alias("file"), "line_no", files.nth_field(F.col("line"), 1).cast("long").alias("doc_id")
    )
)


@query(
    "ticket_tokens",
    f"""WITH {FEED} SELECT f6 AS token, 'T' || file AS ticket FROM feed WHERE line_no = 3 AND f6 <> ''""",
)
def ticket_tokens(t: Tables) -> DataFrame:
    feed = write_feed(t)
    listing = scratch_path(t.spark, "tickets")
    names = files.list_outputs(t.spark, feed).select(
        F.concat_ws("|", F.concat(F.lit("T"), _file_no()), files.plain_path(F.col("path"))).alias("value")
    )
    names.write.text(listing)
    tickets = files.read_pipe_list(t.spark, listing)
    return files.join_tickets(tickets, files.extract_token(files.first_lines(t.spark, feed, 3))).select("token", "ticket")


@query(
    "list_files",
    "SELECT lang, true AS found, true AS recent FROM documents GROUP BY lang",
)
def list_files(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "walk")
    t.documents.select("lang", F.col("doc_id").cast("string").alias("value")).write.partitionBy("lang").text(f"{root}/20240115/data")
    listed = files.list_files(t.spark, root, "2024011", "part-*")
    recent = files.recent_files(t.spark, root).select("path", F.lit(True).alias("recent"))
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")
    return (
        listed.join(recent, "path", "left")
        .groupBy(lang)
        .agg((F.count("timestamp") > 0).alias("found"), F.bool_and(F.coalesce("recent", F.lit(False))).alias("recent"))
    )


@query(
    "listed_files",
    """SELECT lang, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes, lang <> 'de' AS recent FROM documents GROUP BY lang""",
)
def listed_files(t: Tables) -> DataFrame:
    """Bytes of the files found per language, and whether they are recent; those of one language were last changed ten days ago."""
    root = scratch_path(t.spark, "walk")
    t.documents.select("lang", F.col("doc_id").cast("string").alias("value")).write.partitionBy("lang").text(f"{root}/20240115/data")
    old = t.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/20240115/data/lang=de")
    system = old.getFileSystem(t.spark._jsc.hadoopConfiguration())
    for status in system.listStatus(old):  # one file per writing task
        system.setTimes(status.getPath(), status.getModificationTime() - 10 * 86_400_000, -1)
    listed = files.list_files(t.spark, root, "2024011", "part-*").select("path", "length")
    recent = files.recent_files(t.spark, root).select("path", F.lit(True).alias("recent"))
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")
    return listed.join(recent, "path", "left").groupBy(lang).agg(F.sum("length").alias("bytes"), F.coalesce(F.bool_or("recent"), F.lit(False)).alias("recent"))


# --- logs ------------------------------------------------------------------


def log_lines(t: Tables) -> DataFrame:
    """Events as load-log lines: one log per user, markers, completions, lines without a time."""
    kind, table = F.col("event_type"), F.concat(F.lit("t_"), F.col("event_id") % 7)
    tail = (
        F.when(kind == "signup", F.concat(F.lit(" INFO start -hivevar:tablename="), table))
        .when(kind == "purchase", F.concat(F.lit(" Completion: "), F.col("event_id") % 1000, F.lit(" Rows loaded to store."), table))
        .otherwise(F.lit(" INFO running"))
    )
    time = F.when(kind == "error", F.lit("")).otherwise(F.date_format("ts", logs.TIME_FORMAT))
    return t.events.select(
        F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.concat(time, tail).alias("line")
    )


#: folders that the log files are dealt into
LOG_FOLDERS = 96

LOG = """lines AS (SELECT user_id AS file, event_id AS line_no, event_type,
        CASE WHEN event_type = 'signup' THEN 't_' || event_id % 7 END AS marker,
        CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS own_time,
        CASE WHEN event_type = 'purchase' THEN event_id % 1000 END AS loaded FROM events),
carried AS (SELECT *, last_value(marker IGNORE NULLS) OVER w AS "table", last_value(own_time IGNORE NULLS) OVER w AS time
    FROM lines WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stats AS (SELECT file, "table", min_by(time, line_no) FILTER (own_time IS NOT NULL) AS s,
        max_by(time, line_no) FILTER (loaded IS NOT NULL) AS e, max_by(loaded, line_no) FILTER (loaded IS NOT NULL) AS rows
    FROM carried WHERE "table" IS NOT NULL GROUP BY file, "table"),
shown AS (SELECT file, "table", strftime(s, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_time,
        rows, CAST(date_diff('second', s, e) AS DOUBLE) / 60 AS minutes FROM stats)"""


def _shown(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.date_format(c, logs.TIME_FORMAT) for c in ("start_time", "end_time")})


# chunks far below the default, so that values are carried over many of them
query("log_stats", f"WITH {LOG} SELECT * FROM shown")(
    lambda t: _shown(logs.log_table_stats(log_lines(t), chunk_rows=1000))
)
query(
    "top_load_times",
    f"""WITH {LOG} SELECT * FROM shown WHERE minutes IS NOT NULL ORDER BY minutes DESC, file, "table" LIMIT 10""",
)(lambda t: _shown(logs.top_tables(logs.log_table_stats(log_lines(t), chunk_rows=1000), 10, ("file", "table"))))



@query("top_load_times_of_files", f"""WITH {LOG} SELECT minutes FROM shown WHERE minutes IS NOT NULL ORDER BY minutes DESC LIMIT 10""")
def top_load_times_of_files(t: Tables) -> DataFrame:
    """The same logs written as one text file per user and read again.

    The files lie in a bounded number of folders, which are listed by as many tasks: with a folder per user at the top
    every one of them is a task of its own.
    """
    path = scratch_path(t.spark, "logs")
    lines = log_lines(t).withColumn("folder", F.pmod(F.hash("file"), F.lit(LOG_FOLDERS)))
    lines = lines.repartition("folder", "file").sortWithinPartitions("folder", "file", "line_no")
    lines.select("line", "folder", "file").write.partitionBy("folder", "file").text(path)
    return top_load_times(t.spark, path, recursiveFileLookup=True).select("minutes")


@query(
    "top_load_times_of_text",
    f"""WITH {LOG} SELECT * FROM shown WHERE minutes IS NOT NULL ORDER BY minutes DESC, file, "table" LIMIT 10""",
)
def top_load_times_of_text(t: Tables) -> DataFrame:
    """The same logs in a bounded number of text files, whose lines name their log and place, with tables, times and rows."""
    path = scratch_path(t.spark, "logs")
    log_lines(t).select(F.concat_ws("\t", "file", "line_no", "line")).repartition(8).write.text(path)
    parts = F.split("value", "\t", 3)
    lines = t.spark.read.text(path).select(parts[0].cast("long").alias("file"), parts[1].cast("long").alias("line_no"), parts[2].alias("line"))
    return _shown(logs.top_tables(logs.log_table_stats(lines, chunk_rows=1000), 10, ("file", "table")))


query(
    "carry_forward",
    """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""",
)(
    lambda t: carry_forward(
        t.events.select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("value")),
        ["user_id"],
        "event_id",
        ["value"],
        chunk_rows=500,
    )
)

query(
    "global_rank",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders",
)(lambda t: global_rank(t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")]).drop("o_orderdate"))

# --- graphs ----------------------------------------------------------------

query(
    "hierarchy",
    """WITH RECURSIVE h AS (SELECT c_custkey AS reportee_id, c_custkey // 4 AS manager_id FROM customer
       UNION SELECT h.reportee_id, c.c_custkey // 4 FROM h JOIN customer c ON c.c_custkey = h.manager_id) SELECT * FROM h""",
)(
    lambda t: graph.hierarchy(
        t.customer.select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_custkey") / 4).alias("mgr_id"))
    )
)

@query(
    "hierarchy_intervals",
    """WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS level, false AS below
            UNION ALL SELECT c_custkey, level + 1, below OR t.id = 5 FROM t JOIN customer ON c_custkey // 4 = t.id AND c_custkey > 0),
       h AS (SELECT c_custkey AS lower, c_custkey // 4 AS upper FROM customer WHERE c_custkey > 0
            UNION SELECT h.lower, h.upper // 4 FROM h WHERE h.upper > 0),
       n AS (SELECT upper, count(*) AS n FROM h GROUP BY upper)
       SELECT id, CAST(0 AS BIGINT) AS root, level, below, coalesce(n, 0) AS members FROM t LEFT JOIN n ON upper = id""",
)
def hierarchy_intervals(t: Tables) -> DataFrame:
    """Level, size of the part below, and whether it is below customer 5, of every customer."""
    edges = t.customer.select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_custkey") / 4).alias("mgr_id"))
    labels = intervals.interval_labels(edges)
    one = labels.filter("id = 5").select("root", F.col("first").alias("_first"), F.col("last").alias("_last"))
    below = F.coalesce((F.col("first") > F.col("_first")) & (F.col("last") < F.col("_last")), F.lit(False))
    return labels.join(one, "root", "left").select("id", "root", "level", below.alias("below"), intervals.below_count().alias("members"))


query(
    "components",
    "SELECT c_custkey AS id, c_custkey % 25 AS component FROM customer",
)(
    lambda t: graph.connected_components(
        t.customer.select(F.col("c_custkey").alias("id")),
        t.customer.filter("c_custkey >= 25").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") - 25).alias("dst")),
    )
)

query(
    "components_of_hubs",
    """SELECT s_suppkey AS id, CAST(-1 - s_nationkey AS BIGINT) AS component FROM supplier
       UNION ALL SELECT DISTINCT -1 - s_nationkey, -1 - s_nationkey FROM supplier""",
)(
    lambda t: graph.connected_components(
        t.supplier.select(F.col("s_suppkey").alias("id")).unionAll(
            t.supplier.select((-1 - F.col("s_nationkey")).cast("long")).distinct()
        ),
        t.supplier.select(F.col("s_suppkey").alias("src"), (-1 - F.col("s_nationkey")).cast("long").alias("dst")),
    )
)


def lineage_edges(t: Tables) -> DataFrame:
    """nation → supplier → part, with every line item as an edge (many repeated)."""
    supplier, part = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("p"), "l_partkey")
    first = t.supplier.select(
        F.lit(10).alias("stage_seq_no"), F.concat(F.lit("n"), "s_nationkey").alias("source_table"), supplier.alias("dest_table")
    )
    return first.unionAll(t.lineitem.select(F.lit(30), F.concat(F.lit("s"), "l_suppkey"), part))


LINEAGE = """edges AS (SELECT DISTINCT 'n' || s_nationkey AS s, 's' || s_suppkey AS d, 0 AS pos FROM supplier
    UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 1 FROM lineitem),
ends AS (SELECT s AS node, 0 AS i, 1 AS o, pos FROM edges UNION ALL SELECT d, 1, 0, 0 FROM edges)"""

query(
    "degrees",
    f"WITH {LINEAGE} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM ends GROUP BY node",
)(lambda t: graph.degrees(lineage_edges(t)))

query(
    "lineage_nodes",
    f"""WITH {LINEAGE} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree,
        CAST(max(pos) AS BIGINT) AS position FROM ends GROUP BY node""",
)(lambda t: graph.lineage_nodes(lineage_edges(t)))

query(
    "stage_rank",
    "SELECT l_suppkey AS stage_seq_no, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS position FROM (SELECT DISTINCT l_suppkey FROM lineitem)",
)(lambda t: graph.stage_rank(t.lineitem.select(F.col("l_suppkey").alias("stage_seq_no"))))

# --- messages --------------------------------------------------------------


def message_files(t: Tables) -> str:
    """Events as message files: base64 JSON states, some not base64, some not JSON."""
    path = scratch_path(t.spark, "messages")
    key = F.col("event_id")
    state = F.when(F.col("event_type") == "purchase", F.lit("success")).otherwise(F.lit("running"))
    body = F.when(key % 13 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"state":"'), state, F.lit('"}')))
    data = F.when(key % 11 == 0, F.lit("%%%")).otherwise(F.base64(body.cast("binary")))
    published = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    t.events.select(data.alias("data"), published.alias("publishTime")).repartition(12).write.json(path)
    return path


MESSAGES = """decoded AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'base64' WHEN event_id % 13 = 0 THEN 'json' END AS error,
    CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'success' ELSE 'running' END AS state,
    ts FROM events)"""


def streamed(t: Tables) -> DataFrame:
    output, checkpoint = scratch_path(t.spark, "decoded"), scratch_path(t.spark, "offsets")
    decoded = messages.decode_messages(messages.read_messages(t.spark, message_files(t)))
    messages.pull_all(decoded, output, checkpoint)
    return t.spark.read.schema(decoded.schema).parquet(output)


query(
    "decode_messages",
    f"""WITH {MESSAGES} SELECT state, error, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, count(*) AS n FROM decoded GROUP BY ALL""",
)(
    lambda t: streamed(t)
    .groupBy("state", "error", F.date_format(F.to_utc_timestamp("publish_time", F.current_timezone()), logs.TIME_FORMAT).alias("published"))
    .agg(F.count(F.lit(1)).alias("n"))
)

query(
    "messages_gate",
    f"WITH {MESSAGES} SELECT count(*) AS messages, count(error) AS errors, bool_or(state = 'success') AS success FROM decoded",
)(lambda t: messages.success_gate(streamed(t)))


@query(
    "gate_each_batch",
    f"WITH {MESSAGES} SELECT count(*) AS messages, count(error) AS errors, bool_or(state = 'success') AS success FROM decoded",
)
def gate_each_batch(t: Tables) -> DataFrame:
    output, checkpoint = scratch_path(t.spark, "gates"), scratch_path(t.spark, "offsets")
    messages.gate_each_batch(messages.decode_messages(messages.read_messages(t.spark, message_files(t))), output, checkpoint)
    gates = t.spark.read.schema("messages long, errors long, success boolean").parquet(output)
    return gates.agg(
        F.sum("messages").alias("messages"), F.sum("errors").alias("errors"), F.bool_or("success").alias("success")
    )
