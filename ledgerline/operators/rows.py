"""Ordering, ranking and duplicate handling without one-task groups.

A window over a hot key puts that key's rows into one task. The helpers here use
aggregates with map-side combine, range partitions, and joins against one row
per key instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.session import materialize

#: rows produced per step when a counted row is expanded again
COPY_STEP = 10_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL matches NULL; the result keeps the left keys only."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in the total order ``order``.

    Range partitions are sorted and stored once; a row's rank is its position in
    the partition plus the rows of all earlier partitions. The offset table has
    one row per shuffle partition, so broadcasting it is safe at any data size.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos"))
    )
    stored = materialize(placed, "rank")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
        .select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return stored.join(F.broadcast(offsets), "_part").select(
        *[F.col(c) for c in df.columns],
        (F.col("_before") + F.col("_pos") - F.col("_first") + 1).alias(name),
    )


def replicate(df: DataFrame, copies: str) -> DataFrame:
    """Expand each row to ``copies`` rows; a huge count is spread over tasks first."""
    columns = [c for c in df.columns if c != copies]
    left = F.col(copies) - F.col("_step") * COPY_STEP
    steps = (
        df.filter(F.col(copies) > 0)
        .withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPY_STEP))))
        .select(*columns, F.least(left, F.lit(COPY_STEP).cast("long")).alias("_take"))
    )
    many = steps.filter(F.col("_take") == COPY_STEP).repartition(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    few = steps.filter(F.col("_take") < COPY_STEP)
    return (
        few.unionByName(many)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take"))))
        .select(*columns)
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """Key combinations held by more than one row; NULLs group together."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


def rows_of_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once.

    The repeated keys are stored first. They are usually few, and with their true
    size known Catalyst broadcasts them: then only key columns were shuffled.
    """
    repeated = materialize(duplicate_keys(df, keys).select(*keys), "repeated")
    return join_on(df, repeated, keys, "left_semi")


def _ordered_struct(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Column:
    rest = [c for c in df.columns if c not in keys and c not in order]
    return F.struct(*[F.col(c) for c in [*[o for o in order if o not in keys], *rest]])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``, ties by the other columns.

    A struct minimum combines map-side, so a hot key costs one row per map task.
    """
    pick = F.max if last else F.min
    chosen = df.groupBy(*keys).agg(pick(_ordered_struct(df, keys, order)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def rows_after_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Second and later rows of every duplicated key, in the order of ``keep_first``.

    Equal rows are counted instead of compared, so copies never meet in one group.
    """
    columns = df.columns
    counted = rows_of_duplicates(df, keys).groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    row = _ordered_struct(df, keys, order)
    firsts = counted.groupBy(*keys).agg(F.min(row).alias("_first"))
    matched = join_on(counted, firsts, keys)
    is_first = row.eqNullSafe(F.col("_first"))
    remaining = matched.select(
        *columns, (F.col("_copies") - F.when(is_first, 1).otherwise(0)).alias("_copies")
    )
    # stored, as expanding rows reads them twice: as they are, and spread over tasks for large counts
    return replicate(materialize(remaining, "remaining"), "_copies")


def sample_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows per group; each map task keeps only ``n`` before the shuffle."""
    ranked = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") <= n).drop("_rn")


def carry_forward(
    df: DataFrame, group: Sequence[str], position: str, columns: Sequence[str], chunk_rows: int = 100_000
) -> DataFrame:
    """Fill NULLs of ``columns`` with the last earlier value of the group.

    ``position`` is an integer unique within the group. Rows are worked on in
    chunks of at most ``chunk_rows`` positions, so one long log spreads over many
    tasks; only one row per chunk takes part in the ordering of the whole group.
    Each chunk starts with a head row holding the values carried into it.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(position) / chunk_rows))
    last_seen = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_last_{c}") for c in columns
    ]
    chunks = chunked.groupBy(*group, "_chunk").agg(*last_seen)
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = chunks.select(
        *group,
        "_chunk",
        F.lit(True).alias("_head"),
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(c) for c in columns],
    )
    upto = (
        Window.partitionBy(*group, "_chunk")
        .orderBy(F.col("_head").desc(), F.col(position))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        chunked.withColumn("_head", F.lit(False))
        .unionByName(heads, allowMissingColumns=True)
        .select(
            "_head",
            *[
                F.last(c, ignorenulls=True).over(upto).alias(c) if c in columns else F.col(c)
                for c in df.columns
            ],
        )
        .filter(~F.col("_head"))
        .drop("_head")
    )


def pieces(df: DataFrame, keys: Sequence[str], value: str, max_items: int) -> DataFrame:
    """Number the distinct (key, value) rows of ``df`` into pieces of about ``max_items``.

    A key within the bound has the single piece 0. A larger one is split by the
    MD5 of the value, so arrays built per (key, piece) stay bounded and whole.
    """
    large = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > max_items)
        .select(*keys, F.ceil(F.col("_n") / max_items).alias("_pieces"))
    )
    hashed = F.conv(F.substring(F.md5(F.col(value).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return join_on(df, large, keys, "left").select(
        *df.columns,
        F.coalesce(F.pmod(hashed, F.col("_pieces")), F.lit(0).cast("long")).alias("piece"),
    )
