"""Column profiles: what the values of a column look like and which type fits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators.quality import per_column
from ledgerline.session import materialize

# Shapes counted per column.
SHAPES = {
    "bigint_count": "^-?[0-9]+$",
    "float_count": r"^-?[0-9]+(\.[0-9]+)?$",
    "text_count": "^[a-zA-Z]+$",
    "date_count": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "datetime_count": "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
}

# Types tried in this order, the first that fits is recommended.
RECOMMENDED = [
    ("BIGINT", "bigint_count"),
    ("FLOAT", "float_count"),
    ("TEXT", "text_count"),
    ("DATE", "date_count"),
    ("DATETIME", "datetime_count"),
]

# Types every value is tried against; character types fit any value.
CASTS = {
    "bigint_count": "bigint",
    "float_count": "float",
    "double_count": "double",
    "decimal_count": "decimal(38,18)",
    "date_count": "date",
    "datetime_count": "timestamp",
}
CHARACTER_COUNTS = ["char_count", "text_count", "enum_count"]

#: every text that casts to a number looks like this; a failing cast costs an exception per value
NUMBER_LIKE = r"(?i)^[\x00-\x20]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?[df]?|nan|inf(inity)?|0x[0-9a-f.]+p[+-]?[0-9]+[df]?)[\x00-\x20]*$"
GATED = ("bigint", "float", "double", "decimal")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def profile_regex(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: values of each shape, greatest length, non-NULL values."""
    metrics = {
        shape: (lambda c, p=pattern: F.count_if(_text(c).rlike(p))) for shape, pattern in SHAPES.items()
    }
    metrics["max_length"] = lambda c: F.max(F.char_length(_text(c)))
    metrics["total_count"] = lambda c: F.count(F.col(c))
    return per_column(df, list(columns or df.columns), metrics)


def profile_try_cast(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: how many values cast to each type, and all rows."""
    def casting(target: str, name: str) -> Column:
        value = _text(name)
        if target.startswith(GATED):
            value = F.when(value.rlike(NUMBER_LIKE), value)
        return F.count(value.try_cast(target))

    metrics = {name: (lambda c, t=target: casting(t, c)) for name, target in CASTS.items()}
    for name in CHARACTER_COUNTS:
        metrics[name] = lambda c: F.count(F.col(c))
    metrics["total_count"] = lambda c: F.count(F.lit(1))
    return per_column(df, list(columns or df.columns), metrics)


#: longer values share one mask and are tried one by one
MASK_LENGTH = 40
_LONG = "~long"

# What a mask (digits as 9, ASCII letters as a) says about the casts of its values: certain ones per type,
# and the masks that leave a type open. All others exclude it.
CERTAIN = {
    "bigint_count": r"^[+-]?9{1,18}$",
    "float_count": r"^[+-]?9{1,18}(\.9{1,15})?$",
    "double_count": r"^[+-]?9{1,18}(\.9{1,15})?$",
    "decimal_count": r"^[+-]?9{1,18}(\.9{1,15})?$",
    "date_count": None,
    "datetime_count": None,
}
_NUMBER_OPEN = r"^[\x00-\x20]*[+-]?(9|\.9|aaa[\x00-\x20]*$|aaaaaaaa[\x00-\x20]*$)[9a+.\-]*[\x00-\x20]*$"
OPEN = {
    "bigint_count": r"^[\x00-\x20]*[+-]?[9.]+[\x00-\x20]*$",
    "float_count": _NUMBER_OPEN,
    "double_count": _NUMBER_OPEN,
    "decimal_count": _NUMBER_OPEN,
    "date_count": r"^[\x00-\x20]*[+-]?9{4,7}([^9]|$)",
    "datetime_count": r"^[\x00-\x20]*([+-]?9{1,7}([^9]|$)|a9)",
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def value_mask(text: Column) -> Column:
    """The shape of a value: digits as 9, ASCII letters as a, the rest as it is; long values share one."""
    return F.when(F.char_length(text) > MASK_LENGTH, _LONG).otherwise(F.translate(text, "012345678" + _LETTERS, "9" * 9 + "a" * 52))


def profile_casts_by_mask(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same counts as ``profile_try_cast`` from a dictionary of masks per column.

    Values are counted per (column, mask), which combines map-side. A mask settles most casts for all its values at once; only
    values of masks that leave a type open are cast, in a second pass that leaves all others out.
    """
    names = list(columns or df.columns)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _text(c).alias("v")) for c in names])).alias("_c")).select(
        "_c.column", "_c.v", value_mask(F.col("_c.v")).alias("mask")
    )
    mask = F.col("mask")
    certain = {t: F.coalesce(mask.rlike(p), F.lit(False)) if p else F.lit(False) for t, p in CERTAIN.items()}
    undecided = {t: F.coalesce(~certain[t] & (mask.rlike(OPEN[t]) | (mask == _LONG)), F.lit(False)) for t in CASTS}
    counted = cells.groupBy("column", "mask").agg(F.count(F.lit(1)).alias("n"))
    masks = materialize(
        counted.select("column", "mask", "n", *[certain[t].alias(f"y_{t}") for t in CASTS], *[undecided[t].alias(f"o_{t}") for t in CASTS]), "masks"
    )
    any_open = reduce(or_, [F.col(f"o_{t}") for t in CASTS])
    left = cells.join(masks.filter(any_open).drop("n"), ["column", "mask"])
    tried = left.groupBy("column").agg(*[F.count(F.when(F.col(f"o_{t}"), F.col("v").try_cast(target))).alias(f"t_{t}") for t, target in CASTS.items()])
    sure = masks.groupBy("column").agg(
        *[F.sum(F.when(F.col(f"y_{t}"), F.col("n")).otherwise(0)).alias(f"s_{t}") for t in CASTS],
        F.sum(F.when(F.col("mask").isNotNull(), F.col("n")).otherwise(0)).alias("_values"),
        F.sum("n").alias("total_count"),
    )
    return sure.join(tried, "column", "left").select(
        "column",
        *[(F.col(f"s_{t}") + F.coalesce(F.col(f"t_{t}"), F.lit(0))).alias(t) for t in CASTS],
        *[F.col("_values").alias(c) for c in CHARACTER_COUNTS],
        "total_count",
    )


def recommend_type(profile: DataFrame, threshold: str = "0.8") -> DataFrame:
    """Add the first type whose share of non-NULL values reaches the threshold."""
    needed = F.lit(threshold).cast("decimal(10,4)") * F.col("total_count")
    chosen = F.lit("UNKNOWN")
    for name, count in reversed(RECOMMENDED):
        chosen = F.when(F.col(count) >= needed, F.lit(name)).otherwise(chosen)
    return profile.withColumn("recommended_data_type", chosen)
