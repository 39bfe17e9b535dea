"""Cleaning and conforming: every operator is one projection."""

from __future__ import annotations

import datetime
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerline.functions.text import OUTSIDE_WORD_SPACE_HYPHEN, scrub
from ledgerline.functions.values import LOAD_CASTS, cast_for_load, sql_type_to_spark


@dataclass(frozen=True)
class TargetColumn:
    """A column of a load target: name, SQL type, whether NULL is allowed."""

    name: str
    sql_type: str
    nullable: bool = True


@dataclass(frozen=True)
class CleanRules:
    """Text cleaning: ordered (pattern, replacement) rules, then a class to delete."""

    rules: Sequence[tuple[str, str]] = ()
    drop: str | None = OUTSIDE_WORD_SPACE_HYPHEN
    casts: Mapping[str, str] = field(default_factory=lambda: dict(LOAD_CASTS))


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def normalise_types(df: DataFrame) -> DataFrame:
    """Decimal, double and float columns become double."""
    inexact = (T.DecimalType, T.DoubleType, T.FloatType)
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, inexact) else F.col(f.name)
          for f in df.schema.fields]
    )


def scrub_text(df: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Clean every text column."""
    return df.select(
        *[scrub(F.col(c), rules.rules, rules.drop).alias(c) if _is_text(df, c) else F.col(c) for c in df.columns]
    )


def fill_null_text(df: DataFrame, as_text: bool = False) -> DataFrame:
    """NULL text becomes empty text; ``as_text`` turns the other columns into text first."""
    return df.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if as_text or _is_text(df, c) else F.col(c)
            for c in df.columns
        ]
    )


def cast_by_types(df: DataFrame, target: Sequence[TargetColumn], casts: Mapping[str, str] = LOAD_CASTS) -> DataFrame:
    """Cast columns to what their target type is loaded as; misfits become NULL."""
    types = {t.name: t.sql_type for t in target}
    return df.select(
        *[cast_for_load(F.col(c), types.get(c, "string"), dict(casts)).alias(c) for c in df.columns]
    )


def conform_schema(df: DataFrame, target: Sequence[TargetColumn], optional: Sequence[str] = ()) -> DataFrame:
    """Columns of the target in its order.

    A missing NOT NULL column is an error; a missing optional one is added as
    NULL with a warning; other missing or additional columns are left out.
    """
    missing = [t.name for t in target if not t.nullable and t.name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    absent = [c for c in optional if c not in df.columns]
    if absent:
        warnings.warn(f"missing optional columns: {absent}", stacklevel=2)
    return df.select(
        *[
            F.col(t.name) if t.name in df.columns else F.lit(None).cast(sql_type_to_spark(t.sql_type)).alias(t.name)
            for t in target
            if t.name in df.columns or t.name in optional
        ]
    )


def stamp(df: DataFrame, name: str, value: datetime.date | datetime.datetime | None = None) -> DataFrame:
    """Add a load date or time; the current time when no value is given."""
    return df.withColumn(name, F.current_timestamp() if value is None else F.lit(value))


def update_where(df: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    """New table state with ``column`` set where the condition holds."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def column_metadata(df: DataFrame) -> DataFrame:
    """Name, type, nullability and 1-based position of every column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean, position int")
