"""Comparison that moves rows only where the two sides differ.

Keys are dealt into ranges by their hash. Each side sums an order-free digest of every range: row count, XOR and sums
of two row hashes. The sums combine map-side, so a pass shuffles at most one row per task and range. Ranges whose
digests agree hold the same rows on both sides and are left. The others are cut into ``FAN_OUT`` finer ones and
summed again, until they are small or the next cut would not pay. Only the rows of the ranges that remain
meet in the comparison itself. What is shuffled follows the number of differing keys, not of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.values import common_type, comparable
from ledgerline.operators import compare
from ledgerline.operators.compare import CompareSpec
from ledgerline.session import materialize, materialize_with

#: bits of the key hash that each pass adds, and passes at most
PASS_BITS, PASSES = 10, 4
#: rows of a side in a range that is not worth another cut
SMALL_RANGE = 64
#: differing ranges whose numbers may be sent to every executor: 8 bytes each
BROADCAST_RANGES = 200_000


@dataclass(frozen=True)
class Narrowed:
    """Both sides without the ranges that agree, and how many rows the ranges that differ hold."""

    left: DataFrame
    right: DataFrame
    ranges: int
    rows: int


def _key_range(keys: dict[str, Column], bits: int) -> Column:
    """Range of a row's key: the first bits of a hash over the keys and which of them are NULL."""
    nulls = reduce(add, [F.when(k.isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys.values())])
    return F.shiftrightunsigned(F.xxhash64(nulls, *keys.values()), 64 - bits)


def _row_hashes(values: list[Column]) -> tuple[Column, Column]:
    """Two hashes of a row; NULLs, which hashing skips, are marked."""
    marked = [c for v in values for c in (v.isNull(), v)]
    first = F.xxhash64(*marked)
    return first, F.xxhash64(first, F.hash(*marked), *reversed(marked))


def _digests(df: DataFrame, number: Column, values: list[Column], side: str) -> DataFrame:
    one, two = _row_hashes(values)
    half = lambda c, low: c.bitwiseAND(0xFFFFFFFF) if low else F.shiftright(c, 32)
    return (
        df.select(number.alias("range"), one.alias("_h"), two.alias("_g"))
        .groupBy("range")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.struct(
                F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("x"), F.sum(half(F.col("_h"), True)).alias("a"),
                F.sum(half(F.col("_h"), False)).alias("b"), F.sum(half(F.col("_g"), True)).alias("c"), F.sum(half(F.col("_g"), False)).alias("d"),
            ).alias("digest"),
        )
        .select("range", *[F.col(c).alias(f"{c}_{side}") for c in ("rows", "digest")])
    )


def narrowed(left: DataFrame, right: DataFrame, spec: CompareSpec, pass_bits: int = PASS_BITS, small_range: int = SMALL_RANGE) -> Narrowed:
    """The rows of both sides whose key range differs between them.

    A key range holds whole keys, so every comparison of matched cells and of keys on one side only gives the same result for
    the narrowed sides as for the whole ones. ``spec.order`` columns count as content.
    """
    columns = [*compare.compared_columns(left, right, spec), *[o for o in spec.order if o in left.columns and o in right.columns]]
    columns = [c for c in dict.fromkeys(columns) if c not in spec.keys]
    types = {c: common_type(left.schema[c].dataType, right.schema[c].dataType) for c in columns}
    key_types = compare._key_types(left, right, spec.keys)

    def parts(df: DataFrame) -> tuple[dict[str, Column], list[Column]]:
        keys = {k: F.col(k).cast(key_types[k]) for k in spec.keys}
        values = [comparable(F.col(c), df.schema[c].dataType, types[c]) for c in columns]
        return keys, [*keys.values(), *values]

    sides = {"l": left, "r": right}
    found = None
    ranges = rows = 0
    bits = 0
    for _ in range(PASSES):
        bits += pass_bits
        digests = {}
        for name, df in sides.items():
            keys, values = parts(df)
            digests[name] = _digests(df, _key_range(keys, bits), values, name)
        both = digests["l"].join(digests["r"], "range", "full_outer")
        held = F.coalesce("rows_l", F.lit(0)) + F.coalesce("rows_r", F.lit(0))
        differing = both.filter(~F.col("digest_l").eqNullSafe(F.col("digest_r"))).select("range", held.alias("rows"))
        found, seen = materialize_with(differing, "ranges", F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        ranges, rows = seen["n"], seen["rows"]
        if not ranges:
            return Narrowed(left.filter("false"), right.filter("false"), 0, 0)
        # ranges of few rows, or nearly all ranges with too few rows for the next cut to sum up: cutting on leaves little out
        dense = 8 * ranges > 7 << bits and rows < small_range * (ranges << pass_bits)
        if rows <= 2 * small_range * ranges or ranges > BROADCAST_RANGES or dense:
            break
        numbers = F.broadcast(found.select("range"))  # at most BROADCAST_RANGES
        for name, df in sides.items():
            keys, _ = parts(df)
            sides[name] = df.withColumn("_range", _key_range(keys, bits)).join(numbers.withColumnRenamed("range", "_range"), "_range", "left_semi").drop("_range")
    numbers = found.select(F.col("range").alias("_range"))
    numbers = F.broadcast(numbers) if ranges <= BROADCAST_RANGES else numbers
    kept = {}
    for name, df in sides.items():
        keys, _ = parts(df)
        kept[name] = df.withColumn("_range", _key_range(keys, bits)).join(numbers, "_range", "left_semi").drop("_range")
    return Narrowed(kept["l"], kept["r"], ranges, rows)


def mismatch_counts(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """``compare.mismatch_counts`` that shuffles the rows of differing key ranges only."""
    both = narrowed(left, right, spec)
    return compare.mismatch_counts(both.left, both.right, spec)


def cell_diff(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """``compare.cell_diff`` that shuffles the rows of differing key ranges only."""
    both = narrowed(left, right, spec)
    return compare.cell_diff(both.left, both.right, spec)


def differing_keys(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """Keys as text with ``state``: ``only_left``, ``only_right`` or ``differs`` (some cell or, for repeated keys, the rows)."""
    both = narrowed(left, right, spec)
    state = F.when(F.col("n_right") == 0, "only_left").when(F.col("n_left") == 0, "only_right").otherwise("differs")
    pairs = compare.pair_by_key(both.left, both.right, spec)
    unequal = (F.col("n_left") != F.col("n_right")) | reduce(
        lambda a, b: a | b, [compare.differs(F.col(f"l.{c}"), F.col(f"r.{c}")) for c in compare.compared_columns(left, right, spec)]
    )
    keys = pairs.filter(~F.col("ignored") & unequal)
    return keys.select(*[F.col(k).cast("string").alias(k) for k in spec.keys], state.alias("state"))
