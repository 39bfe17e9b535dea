"""Session helpers: the shared scratch folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, laptops) may do without the setting; it
    then gets one temporary folder per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ledgerline-")
    return _LOCAL_ROOTS[app]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Frees what is stored within: use it around an operator and the writing of its result."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch root, removed at the end of its scope or session."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize_with(df: DataFrame, name: str, *totals: Column) -> tuple[DataFrame, dict]:
    """``materialize`` together with aggregates over the rows, taken while they are written."""
    seen = Observation()
    stored = materialize(df.observe(seen, *totals), name)
    return stored, seen.get


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    The result has no lineage, survives lost executors, and gives Catalyst real
    file sizes for its join choices.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
