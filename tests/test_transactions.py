"""Partitions written in batches: one copy after retries, nothing after a failure."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

from ledgerline.sources import transactions
from ledgerline.sources.transactions import FolderTarget, batches_of, read_job, receipts, write_transactional

RETRIED = """
import sys
from pyspark.sql import SparkSession, functions as F
sys.path.insert(0, {root!r})
from ledgerline.sources.transactions import FolderTarget, read_job, receipts, write_transactional

class Failing(FolderTarget):
    def begin(self, job, partition, attempt):
        own = super().begin(job, partition, attempt)
        if partition in (1, 3) and attempt < 2:
            write = own.write
            def fail_later(batch):
                if own.batches == 2:
                    raise RuntimeError("lost between two batches")
                write(batch)
            own.write = fail_later
            if partition == 3:
                own.rollback = lambda: None  # an executor that is gone takes nothing back
        return own

spark = SparkSession.builder.master("local[3,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
df = spark.range(0, 4000, numPartitions=4).withColumn("text", F.concat(F.lit("t"), "id"))
job = write_transactional(df, Failing({path!r}), 300)
back = read_job(spark, {path!r}, job, df.schema)
assert back.count() == 4000 and back.distinct().exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
found = [tuple(r) for r in receipts(spark, {path!r}, job).collect()]
assert found == [(0, 0, 4, 1000), (1, 2, 4, 1000), (2, 0, 4, 1000), (3, 2, 4, 1000)], found
print("kept one copy")
"""


def test_retried_tasks_leave_one_copy(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = RETRIED.format(root=root, path=str(tmp_path / "out"))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, timeout=300)
    assert "kept one copy" in done.stdout, done.stderr[-3000:]
    jobs = [p for p in os.listdir(tmp_path / "out") if p != "_open"]
    assert len(jobs) == 1 and os.listdir(tmp_path / "out" / "_open") == []


class Broken(FolderTarget):
    def begin(self, job, partition, attempt):
        own = super().begin(job, partition, attempt)
        if partition == 1:
            own.write = None
        return own


def test_failed_job_publishes_nothing(spark, tmp_path):
    df = spark.range(0, 100, numPartitions=3)
    with pytest.raises(Exception):
        write_transactional(df, Broken(str(tmp_path)), 10)
    assert not [p for p in os.listdir(tmp_path) if p != "_open"]


def test_types_and_empty_partitions(spark, tmp_path):
    df = spark.sql(
        "SELECT id, CAST(id AS decimal(20,3)) AS d, date_add(DATE'2024-01-01', CAST(id AS int)) AS day, IF(id = 3, NULL, array(id)) AS a,"
        " TIMESTAMP'2024-01-01 10:00:00.123456' AS t, struct(id AS x) AS s FROM range(0, 7, 1, 12)"
    )
    job = write_transactional(df, FolderTarget(f"file://{tmp_path}"), 2)
    back = read_job(spark, f"file://{tmp_path}", job, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    assert receipts(spark, str(tmp_path), job).agg({"rows": "sum"}).first()[0] == 7
    empty = write_transactional(df.filter("false"), FolderTarget(str(tmp_path)), 2)
    assert read_job(spark, str(tmp_path), empty, df.schema).count() == 0


def test_batches_are_whole():
    frames = [pa.record_batch({"x": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 6), (6, 30))]
    sizes = [b.num_rows for b in batches_of(iter(frames), 4)]
    assert sizes == [4] * 7 + [2]
    assert pa.Table.from_batches(batches_of(iter(frames), 7)).column(0).to_pylist() == list(range(30))
    assert transactions.RECEIPT_SCHEMA.count(",") == 3
