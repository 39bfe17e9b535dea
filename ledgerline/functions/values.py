"""Typed value expressions: comparison, casts, SQL type names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# SQL type names and the Spark types they load as.
SQL_TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "string": T.StringType(),
    "double": T.DoubleType(),
    "float": T.DoubleType(),
    "smallint": T.ShortType(),
    "tinyint": T.ByteType(),
    "boolean": T.BooleanType(),
    "decimal": T.DecimalType(38, 18),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "timestamp": T.TimestampType(),
}

# Target type names and the cast used for a load. A decimal is loaded as a
# double on purpose, though a column that is only declared has its decimal type.
LOAD_CASTS = {
    "decimal": "double",
    "double": "double",
    "float": "double",
    "string": "string",
    "varchar": "string",
    "text": "string",
    "integer": "int",
    "int": "int",
    "smallint": "smallint",
    "tinyint": "tinyint",
    "bigint": "bigint",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "datetime": "timestamp",
}

LOAD_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def base_type(name: str) -> str:
    """Type name without length or precision, lower case."""
    return re.split(r"[(\s]", name.strip().lower(), maxsplit=1)[0]


def sql_type_to_spark(name: str) -> T.DataType:
    """Spark type of a SQL type name by its exact base name; unknown names are strings."""
    return SQL_TYPES.get(base_type(name), T.StringType())


def cast_for_load(column: Column, sql_type: str, casts: dict[str, str] = LOAD_CASTS) -> Column:
    """Cast for a load target; a value that does not fit becomes NULL."""
    target = casts.get(base_type(sql_type), "string")
    if target == "timestamp":
        return F.try_to_timestamp(column.cast("string"), F.lit(LOAD_TIMESTAMP))
    return column.try_cast(target)


def _digits(kind: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point that hold every value of an exact number type."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    return (whole[type(kind)], 0) if type(kind) in whole else None


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """Type in which two columns are compared, without loss but for one case; text when they have nothing closer.

    Exact numbers meet in a decimal wide enough for both, or as text beyond 38 digits.
    Pairs with a float or double meet as doubles, which rounds whole numbers beyond 2^53. A date meets a timestamp as its midnight.
    """
    if left == right:
        return left
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return T.LongType()
    ours, theirs = _digits(left), _digits(right)
    if ours and theirs:
        whole, fraction = max(ours[0], theirs[0]), max(ours[1], theirs[1])
        return T.DecimalType(whole + fraction, fraction) if whole + fraction <= 38 else T.StringType()
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        return T.DoubleType()
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(left, times) and isinstance(right, times):
        return T.TimestampType() if T.TimestampType() in (left, right) else T.TimestampNTZType()
    return T.StringType()


def comparable(column: Column, kind: T.DataType, target: T.DataType) -> Column:
    """A column cast to the type of a comparison; numbers as text lose the zeros behind their last digit."""
    if isinstance(target, T.StringType) and isinstance(kind, T.DecimalType):
        text = column.cast("string")
        return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return column.cast(target)


def differs(left: Column, right: Column) -> Column:
    """Null-safe inequality: NULL equals NULL, NULL differs from a value."""
    return ~left.eqNullSafe(right)


def flag_eq(left: Column, right: Column) -> Column:
    """1 when both values are equal, 0 when they differ."""
    return (left == right).cast("int")


def minutes_between(start: Column, end: Column) -> Column:
    """Elapsed minutes with seconds as a fraction."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(60)
