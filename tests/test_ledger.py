"""Calls per key under retries, and modules shipped to workers started elsewhere."""

import os
import subprocess
import sys

from ledgerline.functions.ledger import enrich_once

SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from ledgerline.functions.ledger import enrich_once, ship_modules

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
ship_modules(spark, {helper!r})
counts = {counts!r}

def ask(key):
    import paid_helper
    return paid_helper.ask(counts, key["k"])

df = spark.range(600).selectExpr("id", "id % 50 AS k")
found = enrich_once(df, ["k"], ask, "answer", {ledger!r}, rows_per_file=4)
assert sorted((r.id, r.answer) for r in found.collect()) == [(i, f"answer {{i % 50}}") for i in range(600)]
again = enrich_once(df.union(df.selectExpr("id", "k + 1000")), ["k"], ask, "answer", {ledger!r})
assert again.count() == 1200
print("done")
"""

HELPER = """
import os

def ask(folder, key):
    with open(os.path.join(folder, str(key)), "a") as f:
        f.write("x")
    if key == 7 and os.path.getsize(os.path.join(folder, "7")) == 1:
        raise ValueError("no answer this time")
    return f"answer {key}"
"""


def test_every_key_is_asked_once_under_retries(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("modules", "counts", "elsewhere", "shared"):
        (tmp_path / name).mkdir()
    helper = tmp_path / "modules" / "paid_helper.py"
    helper.write_text(HELPER)
    script = SCRIPT.format(root=root, shared=str(tmp_path / "shared"), helper=str(helper), counts=str(tmp_path / "counts"), ledger=str(tmp_path / "ledger"))
    env = os.environ | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, env=env, cwd=tmp_path / "elsewhere", timeout=300)
    assert "done" in done.stdout, done.stderr[-3000:]
    calls = {int(p.name): p.stat().st_size for p in (tmp_path / "counts").iterdir()}
    assert set(calls) == {*range(50), *range(1000, 1050)}
    assert calls.pop(7) == 2  # the call that raised gave no answer
    assert set(calls.values()) == {1}


def test_null_keys_and_no_rows(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id long, k string")
    found = enrich_once(df, ["k"], lambda key: len(key["k"] or ""), "n", str(tmp_path / "l"), "long")
    assert rows(found, "id", "n") == [(1, 1), (2, 0), (3, 1)]
    assert enrich_once(df.filter("false"), ["k"], lambda key: 0, "n", str(tmp_path / "m"), "long").count() == 0
