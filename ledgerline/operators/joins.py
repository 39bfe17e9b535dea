"""Joins on keys. Catalyst and AQE pick the physical join and split skewed sides.

AQE splits a hot key only where both join inputs come straight from a shuffle.
Existence joins therefore go through ``join_on``: its key expressions differ from
those the distinct keys were grouped by, so those are shuffled again (they are
few) and the side holding the hot key can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.text import strip_zeros
from ledgerline.operators.rows import join_on


def distinct_keys(df: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Distinct keys, renamed when names are given; duplicates collapse before the shuffle."""
    return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names or keys)]).distinct()


def _complete_keys(df: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Distinct keys without NULLs, against which a NULL key matches nothing."""
    return distinct_keys(df.dropna(subset=list(keys)), keys, names)


def join_inner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on shared key columns."""
    return left.join(right, list(keys), "inner")


def new_keys(left: DataFrame, processed: DataFrame, left_key: str, processed_key: str) -> DataFrame:
    """Rows whose key was not processed yet; the key columns may have different names."""
    return join_on(left, _complete_keys(processed, [processed_key], [left_key]), [left_key], "left_anti")


def anti_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the right side lacks; a NULL key never matches, so it is kept."""
    return join_on(left, _complete_keys(right, keys), keys, "left_anti")


def semi_join(left: DataFrame, right: DataFrame, keys: Sequence[str], right_keys: Sequence[str] | None = None) -> DataFrame:
    """Rows whose key occurs on the right side."""
    return join_on(left, _complete_keys(right, right_keys or keys, keys), keys, "left_semi")


def intersect_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], required: bool = False) -> DataFrame:
    """Rows of both sides with equal keys, keys compared as text.

    ``required`` makes it an error if the sides have no key in common.
    """
    def text(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            *[F.col(k).cast("string").alias(k) for k in keys],
            *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys],
        )

    joined = text(left, "left_").join(text(right, "right_"), list(keys))
    if required and joined.select(*keys).isEmpty():
        raise ValueError(f"the sides have no {', '.join(keys)} in common")
    return joined


def self_join_step(edges: DataFrame, closure: DataFrame, child: str, parent: str) -> DataFrame:
    """One step up a hierarchy: the children of every reportee with the reportee's managers."""
    up = closure.select(F.col("reportee_id").alias("_middle"), "manager_id")
    return (
        edges.join(up, edges[parent] == up["_middle"])
        .select(F.col(child).alias("reportee_id"), "manager_id")
        .distinct()
    )


def join_zero_stripped(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Match text keys that are equal apart from leading and trailing zeros."""
    ours = left.withColumn("_stripped", strip_zeros(F.col(left_key)))
    theirs = right.withColumn("_stripped", strip_zeros(F.col(right_key)))
    return ours.join(theirs, "_stripped").drop("_stripped")


def key_columns(constraints: DataFrame, columns: DataFrame, kinds: Sequence[str] = ("PRIMARY KEY", "UNIQUE")) -> DataFrame:
    """Ordered key columns per table and constraint.

    ``constraints``: constraint_name, table_schema, table_name, constraint_type.
    ``columns``: constraint_name, table_schema, table_name, column_name, ordinal_position.
    A constraint has a handful of columns, so its array is small.
    """
    link = ["constraint_name", "table_schema", "table_name"]
    ordered = F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name")))
    return (
        constraints.filter(F.col("constraint_type").isin(*kinds))
        .join(columns, link)
        .groupBy("table_schema", "table_name", "constraint_name", "constraint_type")
        .agg(F.transform(ordered, lambda c: c["column_name"]).alias("key_columns"))
    )
