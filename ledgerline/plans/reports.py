"""Composite reports: many comparisons, table profiles, query lists, load times."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.operators.compare import CompareSpec, report_rows
from ledgerline.operators.logs import log_table_stats, top_tables
from ledgerline.operators.profile import profile_regex, recommend_type
from ledgerline.sources.files import numbered_lines


@dataclass(frozen=True)
class CompareJob:
    """A configured comparison: id, both tables, what to compare."""

    name: str
    left: str
    right: str
    spec: CompareSpec


def _table(spark: SparkSession, frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    return frames[name] if name in frames else spark.table(name)


def compare_many(
    spark: SparkSession, jobs: Sequence[CompareJob], frames: Mapping[str, DataFrame] = {}, top: int | None = 20
) -> DataFrame:
    """Report rows of every job with its name; an invalid job gives one row in section ``invalid``."""
    result = None
    for job in jobs:
        try:
            if not (job.name and job.left and job.right and job.spec.keys):
                raise ValueError("name, both tables and keys are required")
            report = report_rows(_table(spark, frames, job.left), _table(spark, frames, job.right), job.spec, top)
        except (ValueError, AnalysisException) as problem:
            report = spark.createDataFrame(
                [("invalid", str(problem).splitlines()[0], None, None, 0, None)],
                "section string, label string, left_value string, right_value string, n long, example string",
            )
        named = report.select(F.lit(job.name).alias("job"), "*")
        result = named if result is None else result.unionByName(named)
    if result is None:
        raise ValueError("no comparisons configured")
    return result


def profile_table(df: DataFrame, threshold: str = "0.8") -> DataFrame:
    """Column profile with recommended types; a table without columns is an error."""
    return recommend_type(profile_regex(df), threshold)


def run_query_list(spark: SparkSession, queries: Sequence[str]) -> DataFrame:
    """Result rows of several queries: (query_no, query, row as JSON)."""
    result = None
    for number, text in enumerate(queries, 1):
        rows = spark.sql(text.rstrip().rstrip(";"))
        part = rows.select(
            F.lit(number).alias("query_no"), F.lit(text).alias("query"), F.to_json(F.struct(*rows.columns)).alias("row")
        )
        result = part if result is None else result.unionAll(part)
    if result is None:
        raise ValueError("no queries given")
    return result


def top_load_times(spark: SparkSession, path: str, n: int = 10, **options: object) -> DataFrame:
    """Tables of a load log that took longest; ``options`` are those of the text reader."""
    lines = numbered_lines(spark, path, **options)
    return top_tables(log_table_stats(lines, file="path"), n, ties=("path", "table"))
