"""Pulls bounded in messages, and outcomes of runs by timers."""

import datetime
import json
import time

import pytest

from ledgerline.streaming.pulls import MessageReader, pull_available, pull_messages
from ledgerline.streaming.runs import ROCKSDB, STORE, decide_available, run_outcomes


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in"
    place.mkdir()

    def put(name, first, n):
        with open(place / name, "w") as f:
            for i in range(first, first + n):
                f.write(json.dumps({"data": f"m{i} é😀\n", "publishTime": str(i)}) + "\n")

    put("a.json", 0, 1000)
    put("b.json", 1000, 1)
    put("c.json", 1001, 1000)
    return place, put


def test_pulls_hold_at_most_ten_messages(folder, tmp_path):
    place, put = folder
    put("d.json", 2001, 0)
    reader = MessageReader(str(place), str(tmp_path / "progress"), 10)
    start, seen = reader.initialOffset(), []
    for _ in range(250):
        end = reader.latestOffset()
        if end == start:
            break
        own = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.column(1).to_pylist()]
        assert len(own) == end["messages"] - start["messages"] <= 10
        seen += own
        start = end
        if end["messages"] == 500:  # another process goes on
            reader = MessageReader(str(place), str(tmp_path / "progress"), 10)
    assert seen == [str(i) for i in range(2001)]


def test_stretches_cut_within_lines(folder, tmp_path, monkeypatch):
    import ledgerline.streaming.pulls as pulls

    monkeypatch.setattr(pulls, "TASK_BYTES", 101)
    monkeypatch.setattr(pulls, "LOOK_BYTES", 13)
    reader = MessageReader(str(folder[0]), str(tmp_path / "p"), 1500)
    end = reader.latestOffset()
    seen = [r for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for r in b.column(1).to_pylist()]
    assert seen == [str(i) for i in range(1500)]


def test_restarted_stream_loses_and_repeats_nothing(spark, folder, tmp_path):
    place, put = folder
    out, checkpoint, progress = (str(tmp_path / x) for x in ("out", "checkpoint", "progress"))

    def batches():
        rows = pull_messages(spark, str(place), progress, 10)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        while len(query.recentProgress) < 4:
            time.sleep(0.2)
        query.stop()
        return [p["numInputRows"] for p in query.recentProgress]

    assert max(batches()) == 10
    pull_available(pull_messages(spark, str(place), progress, 700), out, checkpoint)
    put("e.json", 2001, 30)
    pull_available(pull_messages(spark, str(place), progress, 700), out, checkpoint)
    found = sorted(int(r.publishTime) for r in spark.read.parquet(out).collect())
    assert found == list(range(2031))


def test_runs_are_decided_by_success_or_time(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m)
    first = [("won", at(0), None), ("won", at(5), "running"), ("won", at(20), "success"), ("won", at(25), "running")]
    first += [("late", at(0), "running"), ("late", at(90), "success"), ("quiet", at(3), None), ("lost", at(1), "running"), ("lost", at(2), "failed")]
    second = [("new", at(200), "running"), ("end", at(10_000), None)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "run string, time timestamp, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema("run string, time timestamp, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    decide_available(run_outcomes(stream, datetime.timedelta(hours=1)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = {r.run: (r.outcome, r.messages, r.decided) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {
        "won": ("success", 2, at(20)),
        "late": ("failed", 1, at(60)),
        "quiet": ("silent", 0, at(63)),
        "lost": ("failed", 2, at(61)),
        "new": ("failed", 1, at(260)),
    }


def test_state_has_pages_of_runs_instead_of_a_row_per_run(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m)
    odd = [None, "", "=", "null", 'a"\n\\', "é😀"]
    first = [(f"r{i}", at(0), "running") for i in range(3000)] + [(n, at(1), None) for n in odd] + [("timeless", None, "success")]
    second = [(f"r{i}", at(2), "success") for i in range(0, 3000, 2)] + [(n, at(3 + i), "") for i, n in enumerate(odd)] + [("end", at(10_000), None)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "run string, time timestamp, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema("run string, time timestamp, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = str(tmp_path / "out")
    spark.conf.set(STORE, ROCKSDB)
    try:
        outcomes = run_outcomes(stream, datetime.timedelta(hours=1))
        query = outcomes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
            kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        finally:
            query.stop()
    finally:
        spark.conf.unset(STORE)
    assert 0 < max(kept) < 1000
    found = {r.run: (r.outcome, r.messages, r.started, r.decided) for r in spark.read.parquet(out).collect()}
    expected = {f"r{i}": ("failed", 1, at(0), at(60)) if i % 2 else ("success", 2, at(0), at(2)) for i in range(3000)}
    assert found == expected | {n: ("failed", 1, at(1), at(61)) for n in odd}
