"""Row-level maintenance as new table states.

Plain files take no MERGE or DELETE, so every operator returns the table as it
is afterwards. Written so that a small source is broadcast by its size and the
large target is then not shuffled at all.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators.joins import anti_by_key, distinct_keys
from ledgerline.operators.rows import join_on, keep_first
from ledgerline.session import materialize


def _latest(source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Source rows with complete keys, the last one per key by ``order``.

    Without an order a repeated key stops the query, as "last" has no meaning.
    """
    complete = source.dropna(subset=list(keys))
    if order:
        return keep_first(complete, keys, order, last=True)
    values = [c for c in source.columns if c not in keys]
    if not values:
        return complete.distinct()
    single = (
        complete.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*values)).alias("_row"))
        .filter(F.expr("assert_true(_n = 1, 'a source key repeats and no order is given') IS NULL"))
    )
    return single.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in source.columns])


def _stored_latest(source: DataFrame, supplied: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The reduced source, stored as it is read several times and its size decides the joins."""
    needed = source.select(*supplied, *[o for o in order if o not in supplied])
    return materialize(_latest(needed, keys, order).select(*supplied), "latest")


def _incomplete(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.filter(missing)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Update existing keys, insert new ones; source rows with a NULL key always insert.

    ``update_columns`` limits what an update changes (default: all other source
    columns). Target columns the source lacks are NULL in inserted rows.
    """
    if not keys:
        raise ValueError("an upsert needs key columns")
    supplied = [c for c in source.columns if c in target.columns]
    updated = [c for c in (update_columns if update_columns is not None else supplied) if c not in keys]
    if not updated:
        raise ValueError("no columns to update besides the keys")
    latest = _stored_latest(source, supplied, keys, order)
    changes = latest.select(*keys, F.struct(*updated).alias("_new"))
    merged = target.join(changes, list(keys), "left").select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in updated else F.col(c)
            for c in target.columns
        ]
    )
    # keys already present, found among the source keys only, so a large target is not shuffled for it
    present = target.select(*keys).join(latest.select(*keys), list(keys), "left_semi").distinct()
    inserts = latest.join(present, list(keys), "left_anti").select(*supplied)
    unkeyed = _incomplete(source, keys).select(*supplied)
    return merged.unionByName(inserts.unionByName(unkeyed), allowMissingColumns=True).select(*target.columns)


def merge_full(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """The same state as ``upsert`` from one full outer join that reads the target once.

    For targets laid out by their keys (``sinks.write_bucketed``): the join then moves the source only. A target without
    that layout is shuffled; there ``upsert`` is better, as a small source leaves the target where it is.
    """
    if not keys:
        raise ValueError("an upsert needs key columns")
    supplied = [c for c in source.columns if c in target.columns]
    updated = [c for c in (update_columns if update_columns is not None else supplied) if c not in keys]
    if not updated:
        raise ValueError("no columns to update besides the keys")
    latest = _latest(source.select(*supplied, *[o for o in order if o not in supplied]), keys, order)
    changes = latest.select(*keys, F.struct(*[F.col(c) for c in supplied]).alias("_new"))
    joined = target.withColumn("_held", F.lit(True)).join(changes, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c in keys or c not in supplied:
            return F.col(c)
        changed = F.col("_new").isNotNull() if c in updated else F.col("_held").isNull()
        return F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)

    merged = joined.select(*[value(c) for c in target.columns])
    unkeyed = _incomplete(source, keys).select(*supplied)
    return merged.unionByName(unkeyed, allowMissingColumns=True).select(*target.columns)


def upsert_non_key(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Upsert where an update changes every non-key column."""
    return upsert(target, source, keys, [c for c in target.columns if c not in keys and c in source.columns], order)


def upsert_touch(
    target: DataFrame, source: DataFrame, keys: Sequence[str], touched: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Upsert where an existing key only gets new values in the ``touched`` columns."""
    return upsert(target, source, keys, touched, order)


def replace(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Whole rows are replaced; columns the source lacks become NULL."""
    supplied = [c for c in source.columns if c in target.columns]
    latest = _stored_latest(source, supplied, keys, order)
    unkeyed = _incomplete(source, keys).select(*supplied)
    kept = target.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest.unionByName(unkeyed), allowMissingColumns=True).select(*target.columns)


def deleted_keys(prod: DataFrame, landing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``prod`` the landing side lacks, NULL keys included, stored.

    Only key columns are shuffled. The result is usually small, so the joins of
    whole rows against it need no shuffle.
    """
    return materialize(anti_by_key(distinct_keys(prod, keys), landing, keys), "deleted")


def deleted_rows(
    prod: DataFrame, landing: DataFrame, keys: Sequence[str], as_of: datetime.date | None = None, stamp_as: str = "as_of_dt"
) -> DataFrame:
    """Rows of ``prod`` whose key the landing side lacks, stamped with the date."""
    gone = join_on(prod, deleted_keys(prod, landing, keys), keys, "left_semi")
    return gone.withColumn(stamp_as, F.current_date() if as_of is None else F.lit(as_of))


def sync_deletes(prod: DataFrame, landing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``prod`` without the rows whose key the landing side lacks."""
    return join_on(prod, deleted_keys(prod, landing, keys), keys, "left_anti")


def deleted_count(prod: DataFrame, landing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows that ``sync_deletes`` removes."""
    return anti_by_key(prod.select(*keys), landing, keys).agg(F.count(F.lit(1)).alias("deleted"))
