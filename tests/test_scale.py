"""Work that grows with the input: partitions, folders and splits follow the rows, and state is touched once per run."""

import datetime
import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Row

from ledgerline.sources import files, sinks, transactions
from ledgerline.streaming import runs
from ledgerline.streaming.runs import RunGate
from ledgerline.suite import file_queries
from ledgerline.suite.registry import Tables


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_receipts_follow_the_tables_splits(spark, tmp_path, small_splits, monkeypatch):
    spark.range(0, 9000, numPartitions=9).write.parquet(str(tmp_path / "lineitem.parquet"))
    small_splits(4000)
    parts, write = [], transactions.write_transactional

    def watched(df, *rest):
        parts.append(df.rdd.getNumPartitions())
        return write(df, *rest)

    monkeypatch.setattr(transactions, "write_transactional", watched)
    assert tuple(file_queries.transactional_receipts(Tables(spark, str(tmp_path))).first()) == (9000, 9000)
    assert parts[0] >= 9


def test_log_files_lie_in_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    events = spark.range(0, 1500).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id * 60) AS ts", "nullif(id % 300, 7) AS user_id",
        "CASE WHEN id < 300 THEN 'signup' WHEN id >= 1200 THEN 'purchase' ELSE 'view' END AS event_type",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    path = str(tmp_path / "logs")
    monkeypatch.setattr(file_queries, "scratch_path", lambda *_: path)
    found = file_queries.top_load_times_of_files(Tables(spark, str(tmp_path))).collect()
    assert [r.minutes for r in found] == [1200.0] * 10
    folders = [f for f in os.listdir(path) if f[0] not in "._"]
    logs = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(logs) == 300 and len(folders) <= file_queries.LOG_FOLDERS


class Handle:
    """Counts what a processor asks of its state store."""

    def __init__(self):
        self.held, self.calls, self.timers = None, [], []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_rows_of_a_decided_run_cost_one_look():
    handle, gate = Handle(), RunGate(datetime.timedelta(seconds=10))
    gate.init(handle)
    ask = lambda *rows: list(gate.handleInputRows(("r",), iter([Row(micros=m, state=s) for m, s in rows]), None))
    assert ask((None, "success")) == [] and handle.held is None
    assert ask((5_000_000, "running"), (None, "success"), (4_000_000, None)) == [] and handle.timers == [14_000]
    assert ask((3_000_000, "running")) == [] and handle.timers == [13_000]
    won = ask((13_000_000, "running"), (12_000_000, "success"), (9_000_000, "running"))
    assert won == [Row(run="r", outcome="success", messages=4, started=3_000_000, decided=12_000_000)] and handle.timers == []
    handle.calls.clear()
    assert ask((12_500_000, "success"), (99_000_000, "running")) == []
    assert handle.calls == ["get"]


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, small_splits, rows):
    texts = ["", None, "\n", '"\n"', "\r", "a\r\nb", '""', 'x,"y\n\n",z', "\n\n\n\n", "plain", " é\n日本 ", "k" * 900 + "\n" + "q" * 900]
    data = [(i, texts[i % len(texts)], texts[(i * 7 + 3) % len(texts)]) for i in range(600)]
    df = spark.createDataFrame(data, "k int, v string, `a \"b` string")
    path = str(tmp_path / "one.csv")
    sinks.export_single_csv(df.repartition(3), path)
    sinks.export_csv(df, str(tmp_path / "many"))
    small_splits(500)
    back = files.read_own_csv(spark, path, df.schema)
    assert rows(back) == rows(df)
    assert rows(files.read_own_csv(spark, str(tmp_path / "many"), df.schema)) == rows(df)
    assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 100
    assert files.read_own_csv(spark, path, df.schema).schema == df.schema


class SlotHandle(Handle):
    """The same with pages beside the value."""

    def __init__(self):
        super().__init__()
        self.pages = {}

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls.append("page")
        return self.pages.get(key)

    def updateValue(self, key, value):
        self.calls.append("put")
        self.pages[key] = value


def fire(gate, handle, key, watermark):
    """Expires timers as Spark does: those before the watermark, each deleted after its call."""
    out = []
    while due := [at for at in handle.timers if at < watermark]:
        info = SimpleNamespace(getExpiryTimeInMs=lambda: min(due))
        out += gate.handleExpiredTimer(key, SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), info)
        handle.timers.remove(min(due))
    return out


def test_runs_of_a_slot_are_decided_as_alone_for_a_look_per_page(monkeypatch):
    monkeypatch.setattr(runs, "PAGE_RUNS", 16)
    within, dice = datetime.timedelta(seconds=50), random.Random(7)
    handle, gate = SlotHandle(), runs.SlotGate(within)
    gate.init(handle)
    alone, names, watermark, decided = {}, [f"={i}é" for i in range(400)] + [""], 0, 0
    for pull in range(30):
        base = pull * 10_000_000
        rows = [(dice.choice(names[: 20 + pull * 20]), dice.randrange(3), base + dice.randrange(-9_000_000, 15_000_000)) for _ in range(60)]
        rows = [r for r in rows if r[2] > watermark * 1000]  # Spark drops late rows
        frames = [pd.DataFrame(rows[i : i + 25], columns=["name", "kind", "micros"]) for i in range(0, len(rows), 25)]
        handle.calls.clear()
        found = [r for f in gate.handleInputRows((3,), iter(frames), None) for r in f.itertuples(index=False)]
        expected = []
        for name in {r[0] for r in rows}:
            if name not in alone:
                alone[name] = Handle(), RunGate(within)
                alone[name][1].init(alone[name][0])
            expected += alone[name][1].handleInputRows((name,), iter([Row(micros=m, state=runs.KINDS[k]) for n, k, m in rows if n == name]), None)
        watermark = base // 1000
        found += [r for f in fire(gate, handle, (3,), watermark) for r in f.itertuples(index=False)]
        for name, (own, one) in alone.items():
            expected += fire(one, own, (name,), watermark)
        assert sorted(map(tuple, found)) == sorted(map(tuple, expected))
        assert len(handle.timers) <= 1
        decided += len(found)
    found = [r for f in fire(gate, handle, (3,), 10**9) for r in f.itertuples(index=False)]
    assert decided + len(found) == len(alone) > 300 and not handle.timers
    assert {len(found), decided} & {0} == set()
    pages = len(handle.pages)
    assert 16 <= pages <= 32
    handle.calls.clear()
    later = pd.DataFrame([(n, 2, 10**12) for n in alone], columns=["name", "kind", "micros"])
    assert list(gate.handleInputRows((3,), iter([later]), None)) == []
    assert handle.calls == ["get"] + ["page"] * pages
