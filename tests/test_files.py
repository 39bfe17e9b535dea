import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.load import load_and_upsert
from ledgerline.plans.reports import run_query_list, top_load_times
from ledgerline.session import materialize, scratch_root, scratch_scope
from ledgerline.sources import files, sinks, tables
from ledgerline.streaming import messages


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def test_numbering_over_many_splits(spark, tmp_path):
    """A file cut into many splits, next to small ones, numbers like a loop over it."""
    expected = {}
    for name, count in (("big.log", 20_000), ("small.log", 3), ("empty.log", 0)):
        lines = [f"{name} {i} " + "x" * (i % 50) for i in range(count)]
        put(tmp_path / name, "".join(line + "\n" for line in lines))
        expected.update({(name, i + 1): line for i, line in enumerate(lines)})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = files.numbered_lines(spark, str(tmp_path))
        got = {(os.path.basename(r.path), r.line_no): r.line for r in df.collect()}
        tail = files.tail_lines(df).groupBy("path").count().collect()
        last = files.last_lines(spark, str(tmp_path)).collect()
        first = files.first_lines(spark, str(tmp_path), 4).collect()
        plan = files.first_lines(spark, str(tmp_path), 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected
    assert sorted(r["count"] for r in tail) == [3, 5]
    name = lambda r: (os.path.basename(r.path), r.line_no)
    assert {name(r): r.line for r in last} == {k: v for k, v in expected.items() if k[0] == "small.log" or k[1] > 19_995}
    assert {name(r): r.line for r in first} == {k: v for k, v in expected.items() if k[1] <= 4}
    assert plan.count("WindowGroupLimit") == 2


def test_header_scan_and_tokens(spark, tmp_path, rows):
    put(tmp_path / "a.dat", "h1\th2\n1\t\t3\tK\t\n1\t2\t3\t4\t5\tTOK\n")
    put(tmp_path / "b.dat", "h\nx\ty\n")
    lines = files.numbered_lines(spark, str(tmp_path))
    header = files.file_header_scan(lines)
    assert rows(header, "key", "empty_fields") == [("K", 2), (None, 0)]
    assert all(r.timestamp for r in header.collect())
    listing = put(tmp_path / "list" / "tickets", f"T1|{tmp_path}/a.dat\nT2|{tmp_path}/b.dat\n")
    tickets = files.read_pipe_list(spark, listing)
    assert rows(files.join_tickets(tickets, files.extract_token(lines)), "token", "ticket") == [("TOK", "T1")]


def test_load_log_file(spark, tmp_path):
    log = put(tmp_path / "load.log", "2024-01-01 10:00:00 hivevar:tablename=t\n2024-01-01 10:03:00 Completion: 5 Rows loaded to s.t\n")
    assert [(r["table"], r.minutes) for r in top_load_times(spark, log).collect()] == [("t", 3.0)]


def test_tickets_with_odd_paths(spark, tmp_path, rows):
    put(tmp_path / "a b+c%d.dat", "1\n2\n1\t2\t3\t4\t5\tTOK\n")
    listing = put(tmp_path / "list" / "tickets", f"T1|{tmp_path}/a b+c%d.dat\n")
    tokens = files.extract_token(files.numbered_lines(spark, str(tmp_path)))
    assert rows(files.join_tickets(files.read_pipe_list(spark, listing), tokens), "token", "ticket") == [("TOK", "T1")]


def test_url_list(spark, tmp_path, rows):
    good = put(tmp_path / "good", "https://h/x,id\n\nhttp://h/y,a,b\n")
    assert rows(files.read_url_list(spark, good), "url", "id_column") == [("http://h/y", "a,b"), ("https://h/x", "id")]
    bad = put(tmp_path / "bad", "https://h/x,id\nftp://h,id\nhttps://h\nhttps://h,\n")
    errors = [e for _, e in rows(files.read_url_list(spark, bad, strict=False), "url", "error")]
    assert sorted(map(str, errors)) == ["None", "invalid url", "missing id column", "no comma"]
    with pytest.raises(Exception, match="bad source line"):
        files.read_url_list(spark, bad).collect()


def test_keyed_csvs(spark, tmp_path, rows):
    put(tmp_path / "A1" / "d.csv", "id,v\n01,1\n02,2\n")
    put(tmp_path / "A2" / "d.csv", "id,w\n03,x\n")
    combined, counts = files.read_keyed_csvs(spark, str(tmp_path) + "/{key}/d.csv", ["A1", "A2", "A3"], ["id"])
    assert rows(counts) == [("A1", 2, None), ("A2", 1, None), ("A3", 0, "missing")]
    assert rows(combined, "id", "v", "w", "source_key") == [("01", 1, None, "A1"), ("02", 2, None, "A1"), ("03", None, "x", "A2")]
    nothing, counts = files.read_keyed_csvs(spark, str(tmp_path) + "/{key}/no.csv", ["A1"], ["id"])
    assert nothing is None and rows(counts) == [("A1", 0, "missing")]
    put(tmp_path / "B1" / "a b+c.csv", "id,v\n1,7\n")
    put(tmp_path / "B2" / "a b+c.csv", "id,v\n2,text\n")
    put(tmp_path / "B3" / "a b+c.csv", "id,v\n")
    put(tmp_path / "B4" / "a b+c.csv", "")
    put(tmp_path / "B5" / "a b+c.csv", "x,v\n1,2\n")
    combined, counts = files.read_keyed_csvs(spark, str(tmp_path) + "/{key}/a b+c.csv", [f"B{i}" for i in range(1, 6)], ["id"])
    assert rows(combined, "id", "v", "source_key") == [("1", "7", "B1"), ("2", "text", "B2")]
    assert rows(counts, "rows", "error") == [(0, "empty"), (0, "no id"), (0, "no rows"), (1, None), (1, None)]
    assert rows(files.source_status(counts, combined), "source_key", "success") == [("B1", True), ("B2", True), ("B3", False), ("B4", False), ("B5", False)]
    one_scan = files.csv_records(spark, {k: f"{tmp_path}/{k}/d.csv" for k in ("A1", "A2")}, "id string, v string")
    assert rows(one_scan.groupBy("source_key").count()) == [("A1", 2), ("A2", 1)]


def test_export_import(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    for sep, token, line in (("|", "", "1||x"), ("^", "NULL", "1^NULL^x")):
        path = str(tmp_path / f"out{token}")
        sinks.export_delimited(df, path, sep, token)
        assert [r.value for r in spark.read.text(path).collect()] == [line]
        assert rows(files.import_delimited(spark, path, df.schema, sep, null_token=token or None)) == [(1, None, "x")]
    empty = files.import_delimited(spark, str(tmp_path / "out"), df.schema, "|", nullif_empty=False)
    assert rows(empty) == [(1, "", "x")]


HARD = ['say "hi", all', "", None, " a\nb\r\nc ", "\\", "a\\|^b\\", "^|", "\\N", "\\n", "\u0001a", "#x", "é", '"', "NULL", "\t", "a\\"]


def test_hard_values_survive_both_formats(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(HARD)], "k int, v string, `a \"b` string")
    sinks.export_csv(df, str(tmp_path / "c"))
    assert rows(files.read_own_csv(spark, str(tmp_path / "c"), df.schema)) == rows(df)
    sinks.export_single_csv(df.repartition(3), str(tmp_path / "one.csv"))
    assert rows(files.read_own_csv(spark, str(tmp_path / "one.csv"), df.schema)) == rows(df)
    for i, sep in enumerate(("|", "^", ",", ";;")):
        sinks.export_delimited(df, str(tmp_path / f"d{i}"), sep, "\\N")
        back = files.import_delimited(spark, str(tmp_path / f"d{i}"), df.schema, sep, nullif_empty=False, null_token="\\N")
        assert rows(back) == rows(df)


def test_csv_quoting(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'say "hi", all', None)], "a int, b string, c string")
    sinks.export_csv(df, str(tmp_path / "q"))
    assert rows(files.read_csv_dir(spark, str(tmp_path / "q"))) == [(1, 'say "hi", all', None)]
    sinks.export_single_csv(df, str(tmp_path / "s.csv"))
    with pytest.raises(Exception, match="already exists"):
        sinks.export_single_csv(df, str(tmp_path / "s.csv"))
    with pytest.raises(Exception, match="already exists"):
        sinks.export_csv(df, str(tmp_path / "q"))


def test_ledger(spark, tmp_path, rows):
    put(tmp_path / "in" / "a", "1|x\n2|y\n")
    put(tmp_path / "in" / "b", "1|x\nbad|y\n")
    put(tmp_path / "in" / "c", "no|x\n")
    put(tmp_path / "in" / "d e", "")
    put(tmp_path / "more" / "a", "1|oops|x|2024-01-01\n1|2|x|never\n1|2|x\n1|2|x|2024-01-01|5\n1|2|x|2024-01-01\n||| \n")
    columns = "k int, n int, v string, d date"
    found = files.read_delimited(spark, str(tmp_path / "more"), columns, keys=["k"])
    assert rows(found, "_error") == [("fields: 3 instead of 4",), ("fields: 5 instead of 4",), ("value of d",), ("value of d",), ("value of n",), (None,)]
    assert rows(files.load_ledger(spark, str(tmp_path / "more"), columns), "rows_loaded", "bad_rows") == [(1, 5)]
    with pytest.raises(Exception, match="bad line"):
        files.import_delimited(spark, str(tmp_path / "more"), columns).collect()
    ledger = files.load_ledger(spark, str(tmp_path / "in"), "k int, v string")
    assert rows(ledger, "rows_loaded", "bad_rows", "status") == [(0, 0, "loaded"), (0, 1, "failed"), (1, 1, "partial"), (2, 0, "loaded")]
    assert rows(files.ledger_totals(ledger)) == [(4, 2, 2, 3)]


def test_load_and_upsert(spark, tmp_path, rows):
    path = put(tmp_path / "in" / "part-0", "1^new\n3^add\n")
    prod = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string")
    result = load_and_upsert(spark, path, prod, ["k"])
    assert rows(result.state) == [(1, "new"), (2, "keep"), (3, "add")]
    assert rows(result.totals) == [(1, 1, 0, 2)]
    path = put(tmp_path / "bad" / "part-0", "1^oops^new\nbad^5^x\n^5^x\n2^7^good\n")
    prod = spark.createDataFrame([(1, 5, "old"), (2, 6, "keep")], "k int, n int, v string")
    result = load_and_upsert(spark, path, prod, ["k"])
    assert rows(result.state) == [(1, 5, "old"), (2, 7, "good")]
    assert rows(result.rejects, "_error") == [("no k",), ("value of k",), ("value of n",)]
    assert rows(result.totals) == [(1, 0, 1, 1)]


def test_listings(spark, tmp_path):
    new = tmp_path / "20240115" / "data" / "sub" / "ap_load_1.dat"
    put(new, "x")
    put(tmp_path / "20240115" / "data" / "sub" / "other.dat", "x")
    put(tmp_path / "20231201" / "data" / "sub" / "ap_load_2.dat", "x")
    listed = files.list_files(spark, str(tmp_path), "2024011").collect()
    assert [os.path.basename(r.path) for r in listed] == ["ap_load_1.dat"]
    old = time.time() - 5 * 86400
    os.utime(new, (old, old))
    recent = {os.path.basename(r.path) for r in files.recent_files(spark, str(tmp_path)).collect()}
    assert recent == {"other.dat", "ap_load_2.dat"}


def test_partition_writer(spark, tmp_path):
    class FolderSink:
        """Writes each batch as a file on commit; used to see batches from outside."""

        def __init__(self, folder):
            self.folder, self.batch = folder, None

        def write(self, batch):
            self.batch = batch
            if any(k < 0 for k in batch["k"].to_pylist()):
                raise ValueError("negative key")

        def commit(self):
            with open(f"{self.folder}/{self.batch['k'][0]}.csv", "w") as f:
                f.write("\n".join(map(str, self.batch["k"].to_pylist())))

        def rollback(self):
            open(f"{self.folder}/rolled_back", "w").close()

        def close(self):
            pass

    folder = str(tmp_path)
    ledger = sinks.write_partitions(spark.range(25).selectExpr("id AS k").coalesce(2), lambda: FolderSink(folder), 10)
    totals = ledger.agg(F.sum("rows"), F.sum("batches")).first()
    assert totals[0] == 25 and totals[1] == len(os.listdir(folder)) == 4
    bad = spark.range(-1, 3).selectExpr("id AS k").coalesce(1)
    with pytest.raises(Exception, match="negative key"):
        sinks.write_partitions(bad, lambda: FolderSink(folder), 10).collect()
    assert "rolled_back" in os.listdir(folder)


def test_run_dated_keeps_other_days(spark, tmp_path, rows):
    import datetime

    df = spark.createDataFrame([(1,)], "k int")
    for day in (1, 2, 1):
        sinks.write_run_dated(df, str(tmp_path / "r"), datetime.date(2024, 1, day))
    stored = spark.read.schema("k int, run_date string").parquet(str(tmp_path / "r"))
    assert rows(stored) == [(1, "01012024"), (1, "01022024")]


def test_tables_and_sql(spark, tmp_path, rows):
    sinks.save_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "scan_me", "overwrite")
    assert rows(tables.scan_table(spark, "scan_me", ["v"])) == [("a",), ("b",)]
    path = put(tmp_path / "scan_me.sql", "SELECT v FROM scan_me\nWHERE k = :k;\n")
    assert rows(tables.scan_sql_file(spark, path, {"k": 2})) == [("b",)]
    assert tables.literal_df(spark, [], "k int").isEmpty()
    listed = run_query_list(spark, ["SELECT k FROM scan_me;", "SELECT count(*) AS n FROM scan_me"])
    assert rows(listed, "query_no", "row") == [(1, '{"k":1}'), (1, '{"k":2}'), (2, '{"n":2}')]


def test_materialize_uses_the_shared_folder(spark, rows):
    df = spark.createDataFrame([(1, None)], "k int, v string")
    stored = materialize(df, "t")
    assert rows(stored) == rows(df) and stored.schema == df.schema
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all("shared" in f for f in stored.inputFiles())


def test_scratch_is_freed_at_the_end_of_its_scope(spark):
    with scratch_scope(spark):
        path = materialize(spark.range(3), "scoped").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


SUCCESS = "eyJzdGF0ZSI6InN1Y2Nlc3MifQ=="
TIME = "2024-01-01T10:00:00.000001Z"


def test_messages(spark, rows):
    schema = messages.MESSAGE_SCHEMA
    good = messages.decode_messages(spark.createDataFrame([(SUCCESS, TIME)], schema))
    assert rows(messages.success_gate(good)) == [(1, 0, True)]
    messages.require_success(good)
    bad = messages.decode_messages(spark.createDataFrame([("%%%", TIME), ("bm8=", TIME), ("c3Vj//8=", TIME), (SUCCESS, "never")], schema))
    assert rows(bad, "state", "error", "data") == [(None, "base64", "%%%"), (None, "base64", "c3Vj//8="), (None, "json", "bm8="), (None, "time", SUCCESS)]
    with pytest.raises(ValueError, match="no success"):
        messages.require_success(bad)
    with pytest.raises(ValueError, match="no messages"):
        messages.require_success(bad.limit(0))
    plain = messages.decode_messages(spark.createDataFrame([('{"state":"success"}', TIME)], schema), encoded=False)
    assert rows(messages.success_gate(plain)) == [(1, 0, True)]


def test_stream_takes_new_files_once(spark, tmp_path):
    inbox, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    put(tmp_path / "in" / "1.json", f'{{"data":"{SUCCESS}","publishTime":"{TIME}"}}\n')

    def stored():
        messages.pull_all(messages.decode_messages(messages.read_messages(spark, inbox, 1)), out, offsets)
        return spark.read.parquet(out).count()

    assert [stored(), stored()] == [1, 1]
    put(tmp_path / "in" / "2.json", f'{{"data":"%%%","publishTime":"{TIME}"}}\n')
    assert stored() == 2


@pytest.mark.parametrize("sep", ["", "\\", "n", "\n", "|r", "a\\b"])
def test_separators_that_escapes_need_are_refused(spark, tmp_path, sep):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    with pytest.raises(ValueError, match="separator"):
        sinks.export_delimited(df, str(tmp_path / "out"), sep)
    with pytest.raises(ValueError, match="separator"):
        files.read_delimited(spark, str(tmp_path), "s string, n int", sep)


@pytest.mark.parametrize("sep", ["|", "-", ".", "::", "1", "\t", "\u0001"])
def test_any_other_separator_round_trips(spark, rows, tmp_path, sep):
    texts = ["", "a|b", "\\", "\\n", "x\ny\r", "1-1.1::1\t", "\u0001b\u0001", "\\|\\\\"]
    df = spark.createDataFrame([(t, -i * 1.5, datetime.date(2024, 1, 11)) for i, t in enumerate(texts)] + [(None, None, None)], "s string, v double, d date")
    sinks.export_delimited(df, str(tmp_path / "out"), sep, "\\N")
    back = files.import_delimited(spark, str(tmp_path / "out"), df.schema, sep, nullif_empty=False, null_token="\\N")
    assert rows(back) == rows(df)
