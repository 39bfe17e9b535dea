"""Helpers shared by the operators: words, distributed running totals, per-process caches."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Sequence
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.operators.rows import join_on
from ledgerline.session import materialize

#: a word: a run of characters other than space and the ASCII control spaces
WORD = "[^\\x20\\x09-\\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_count(text: str) -> Column:
    """Number of words of a text column; NULL and empty texts have none.

    Every word becomes one letter and what is between them goes, so no array of the words is built.
    """
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], totals: dict[str, str]
) -> DataFrame:
    """Add to every row the sums over the earlier rows of its group.

    ``totals`` maps a new column to the summed one. Rows are range-sorted by group
    and order, stored once, summed within each (range, group), and shifted by the
    totals of the group's earlier ranges. A hot group spans many ranges; the table
    of range totals has at most one row per range and group. NULL is a group.
    """
    keys = [*[F.col(c).asc_nulls_last() for c in group], *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos"))
    )
    stored = materialize(placed, "totals")
    earlier_parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier_rows = Window.partitionBy("_part", *group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    shifts = (
        stored.groupBy("_part", *group)
        .agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
        .select("_part", *group, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier_parts), zero).alias(f"_shift_{n}") for n in totals])
    )
    within = stored.select(
        "*", *[F.coalesce(F.sum(c).over(earlier_rows), zero).alias(f"_within_{n}") for n, c in totals.items()]
    )
    return join_on(within, shifts, ["_part", *group]).select(
        *df.columns, *[(F.col(f"_within_{n}") + F.col(f"_shift_{n}")).alias(n) for n in totals]
    )


#: rows of a few numbers that may be sent to every executor: about 16 MB
BROADCAST_ROWS = 500_000


def sized(stored: DataFrame) -> DataFrame:
    """A stored frame of a few number columns, to be broadcast if it has at most ``BROADCAST_ROWS`` rows.

    Beyond that it is joined by a shuffle, with the same result.
    """
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def process_cache(name: str, build: Callable[[], object]) -> object:
    """Build once per Python process and keep it.

    Functions reach the workers by value, so a module global would not outlive a
    task; a module registered under a name of its own does.
    """
    home = sys.modules.setdefault("_ledgerline_llm_cache", ModuleType("_ledgerline_llm_cache"))
    if not hasattr(home, name):
        setattr(home, name, build())
    return getattr(home, name)


def sent_by_value(spark: SparkSession, value: object) -> Callable[[], tuple[str, object]]:
    """Broadcast an object with its class, for workers that can't import this package; the result gives its name and itself.

    The name is a hash of the content. Every Python process builds the object once.
    """
    data = cloudpickle.dumps(value)
    shared, name = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    return lambda: (name, process_cache(f"value:{name}", lambda: cloudpickle.loads(shared.value)))
