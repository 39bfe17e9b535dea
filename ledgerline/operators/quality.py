"""Counts and checks over whole tables, each in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerline.functions.text import is_blank
from ledgerline.functions.values import flag_eq

#: columns aggregated together; parquet columns are read once whatever the grouping
COLUMNS_PER_PASS = 50


def per_column(df: DataFrame, columns: Sequence[str], metrics: Mapping[str, object]) -> DataFrame:
    """One row per column with aggregates of it; ``metrics`` maps a name to Column → aggregate.

    All columns of a pass are aggregated side by side, so rows are never
    multiplied by the number of columns and nothing but totals is shuffled.
    """
    if not columns:
        raise ValueError("no columns to examine")
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = columns[start : start + COLUMNS_PER_PASS]
        totals = df.agg(
            *[make(c).alias(f"m{i}_{name}") for i, c in enumerate(chunk) for name, make in metrics.items()]
        )
        parts.append(
            totals.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(c).alias("column"),
                                *[F.col(f"m{i}_{name}").alias(name) for name in metrics],
                            )
                            for i, c in enumerate(chunk)
                        ]
                    )
                )
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every named table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    if not counts:
        raise ValueError("no tables to count")
    result = counts[0]
    for part in counts[1:]:
        result = result.unionAll(part)
    return result


def count_by(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def total_of(counts: DataFrame, column: str = "count", name: str = "total") -> DataFrame:
    """Sum of per-key counts."""
    return counts.agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))


def validate_counts(df: DataFrame, key: str, declared: str, counted: str | None = None) -> DataFrame:
    """Actual against declared rows per key, and 1 or 0 for equal or not."""
    what = F.col(counted) if counted else F.lit(1)
    return (
        df.groupBy(key)
        .agg(F.count(what).alias("record_count"), F.max(declared).alias("declared_count"))
        .withColumn("validation", flag_eq(F.col("record_count"), F.col("declared_count")))
    )


def blank_counts(df: DataFrame, columns: Sequence[str] | None = None, only_found: bool = True) -> DataFrame:
    """Blank values (spaces only) per column; columns that are not text have none."""
    columns = list(columns or df.columns)

    def blanks(name: str) -> Column:
        if not isinstance(df.schema[name].dataType, T.StringType):
            return F.max(F.lit(0)).cast("long")
        return F.count_if(is_blank(F.col(name)))

    counts = per_column(df, columns, {"blanks": blanks}).withColumn("blanks", F.coalesce("blanks", F.lit(0)))
    return counts.filter("blanks > 0") if only_found else counts


def null_counts(df: DataFrame, not_null_columns: Sequence[str]) -> DataFrame:
    """NULLs and NULL-or-blank values of columns that must be filled, with a warning flag."""
    return per_column(
        df,
        list(not_null_columns),
        {
            "nulls": lambda c: F.count_if(F.col(c).isNull()),
            "nulls_or_blanks": lambda c: F.count_if(F.col(c).isNull() | is_blank(F.col(c).cast("string"))),
        },
    ).withColumn("warning", F.col("nulls_or_blanks") > 0)


def distinct_count(df: DataFrame, keys: Sequence[str], exact: bool = True) -> DataFrame:
    """Number of distinct keys, NULL keys included when exact; approximate for sizing."""
    if not exact:
        return df.agg(F.approx_count_distinct(F.struct(*keys)).alias("distinct_keys"))
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("distinct_keys"))


def keyword_counts(names: DataFrame, column: str, separator: str = "_") -> DataFrame:
    """Tokens of names with their number, most frequent first, then by token."""
    return (
        names.select(F.explode(F.split(F.col(column), _literal(separator))).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("keyword"))
    )


def _literal(separator: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_ " else "\\" + ch for ch in separator)


def column_names(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Names of all columns of the given tables."""
    rows = [(name, c) for name, df in tables.items() for c in df.columns]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, column string")
