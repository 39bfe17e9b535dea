"""Partition sizing, packing of keys into bins, and repartitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerline.operators.rows import global_rank
from ledgerline.session import materialize


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per physical partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def choose_partitions(df: DataFrame, key: str, cores: int, exact: bool = False) -> DataFrame:
    """Rows, distinct keys, and max(1, min(max(2·cores, keys), rows div 1000))."""
    if exact:
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        sized = per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(key).alias("distinct_keys")
        )
    else:
        sized = df.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(key).alias("distinct_keys"))
    wanted = F.greatest(F.lit(2 * cores).cast("long"), F.col("distinct_keys"))
    return sized.withColumn(
        "partitions", F.greatest(F.lit(1).cast("long"), F.least(wanted, F.expr("rows div 1000")))
    )


#: size of a sketch as a power of two, and three standard errors of its estimate
SKETCH_SIZE, SKETCH_ERROR = 12, 0.05


def distinct_sketches(df: DataFrame, key: str, part: str) -> DataFrame:
    """(part, rows, sketch): rows and a sketch of the distinct keys of every part, to be stored beside the data.

    A sketch has at most a few kB whatever the number of keys; keys are whole numbers, text or binary.
    """
    return df.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(key, SKETCH_SIZE).alias("sketch"))


def merge_sketches(kept: DataFrame, added: DataFrame) -> DataFrame:
    """Sketches after an append: only the new rows' sketches are worked out."""
    return kept.unionByName(added).groupBy("part").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def choose_partitions_from(sketches: DataFrame, cores: int) -> DataFrame:
    """``choose_partitions`` from kept sketches; the data is not read."""
    sized = sketches.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct_keys")
    )
    wanted = F.greatest(F.lit(2 * cores).cast("long"), F.col("distinct_keys"))
    return sized.withColumn("partitions", F.greatest(F.lit(1).cast("long"), F.least(wanted, F.expr("rows div 1000"))))


def choose_partitions_by_rows(df: DataFrame, test_slice: bool = False) -> DataFrame:
    """Rows and max(10, min(rows div 1,000,000, 100)); for a test slice min(rows, 10)."""
    formula = "least(rows, 10L)" if test_slice else "greatest(10L, least(rows div 1000000, 100L))"
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("partitions", F.expr(formula))


def _next_fit_runs(runs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Place runs of equally large keys, largest first; a new bin opens when one would overflow."""
    bin_no = load = seen = 0
    for batch in runs:
        placed = []
        for size, keys, capacity in zip(batch["size"], batch["keys"], batch["capacity"]):
            per_bin = max(1, capacity // size)
            here = per_bin if load == 0 else max(0, (capacity - load) // size)
            placed.append((size, seen, bin_no, here, per_bin))
            seen += keys
            beyond = keys - here
            if beyond <= 0:
                load += keys * size
            else:
                opened = -(-beyond // per_bin)
                bin_no += opened
                load = (beyond - (opened - 1) * per_bin) * size
        yield pd.DataFrame(placed, columns=["size", "before", "first_bin", "here", "per_bin"])


def pack_keys(counts: DataFrame, key: str, size: str, bins: int) -> DataFrame:
    """Next-fit packing of keys, size descending then key: (key, size, bin).

    A bin closes when it holds something and the next key would exceed
    total div bins. Equal sizes form one run placed by arithmetic. Sizes are
    positive, so a table of N rows has at most sqrt(2N) runs (1.4 million for
    10^12 rows); only these pass through one task, the keys themselves do not.
    """
    ranked = global_rank(
        counts.select(key, F.col(size).cast("long").alias("size")), [F.col("size").desc(), F.col(key)], "_rank"
    )
    grouped = ranked.groupBy("size").agg(F.count(F.lit(1)).alias("keys"))
    total = ranked.agg(F.floor(F.sum("size") / F.lit(bins)).alias("capacity"))
    runs = (
        grouped.withColumn("_all", F.lit(0))
        .join(F.broadcast(total.withColumn("_all", F.lit(0))), "_all")
        .select("size", "keys", "capacity")
        .repartition(1)
        .sortWithinPartitions(F.col("size").desc())
        .mapInPandas(_next_fit_runs, "size long, before long, first_bin long, here long, per_bin long")
    )
    place = F.col("_rank") - 1 - F.col("before")
    later = F.col("first_bin") + 1 + F.floor((place - F.col("here")) / F.col("per_bin"))
    packed = ranked.join(runs, "size").select(
        key, "size", F.when(place < F.col("here"), F.col("first_bin")).otherwise(later).cast("int").alias("bin")
    )
    return materialize(packed, "bins")


def assign_bins(df: DataFrame, bins: DataFrame, key: str) -> DataFrame:
    """Attach its bin to every row; a key without a bin gets 0."""
    return df.join(bins.select(key, "bin"), key, "left").withColumn("bin", F.coalesce("bin", F.lit(0)))


def repartition_by(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Hash partitions by key, or evenly spread ones without a key."""
    return df.repartition(n, *keys)


def repartition_bins(df: DataFrame, n: int, bin_column: str = "bin") -> DataFrame:
    """Range partitions by bin, so neighbouring bins stay together and none is split."""
    return df.repartitionByRange(n, bin_column)
