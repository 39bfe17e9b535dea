"""Keyed comparison of two versions of a table.

Each side is reduced to its row count and first row per key, which combines
map-side however many rows share a key. The two reduced sides are then joined on
the partitioning the reduction left behind, so every side is shuffled once and no
join meets a hot key. All comparison results derive from these pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerline.functions.values import common_type, comparable, differs
from ledgerline.operators.rows import join_on, sample_per_group
from ledgerline.session import materialize

#: longest list of ignored keys sent to every executor
IGNORE_BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class CompareSpec:
    """What to compare: key columns, columns left out, keys left out, row order."""

    keys: Sequence[str]
    ignore_columns: Sequence[str] = ()
    ignore_keys: Sequence[Mapping[str, object]] | DataFrame | None = None
    order: Sequence[str] = field(default=())


def column_diff(left: DataFrame, right: DataFrame, left_id: str | None = None, right_id: str | None = None) -> DataFrame:
    """Columns of either side with where they occur: ``left``, ``right`` or ``both``."""
    ours = [c for c in left.columns if c != left_id]
    theirs = [c for c in right.columns if c != right_id]
    rows = [
        (c, "both" if c in ours and c in theirs else "left" if c in ours else "right")
        for c in sorted({*ours, *theirs})
    ]
    return left.sparkSession.createDataFrame(rows, "column string, side string")


def compared_columns(left: DataFrame, right: DataFrame, spec: CompareSpec) -> list[str]:
    """Left columns compared with the right side; a missing key or no column is an error."""
    for key in spec.keys:
        if key not in left.columns or key not in right.columns:
            raise ValueError(f"key column {key!r} is missing from one side")
    columns = [
        c for c in left.columns if c in right.columns and c not in spec.keys and c not in spec.ignore_columns
    ]
    if not columns:
        raise ValueError("no common columns to compare")
    return columns


def _key_types(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> dict[str, T.DataType]:
    """Keys match as text; whole numbers of either width give the same matches without the text."""
    types = {k: common_type(left.schema[k].dataType, right.schema[k].dataType) for k in keys}
    return {k: t if isinstance(t, T.IntegralType) else T.StringType() for k, t in types.items()}


def _as_text(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if c in keys else F.col(c) for c in df.columns])


def key_presence(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys with the row count of each side. Reads key columns only."""
    types = _key_types(left, right, keys)
    typed = [F.col(k).cast(types[k]).alias(k) for k in keys]
    both = left.select(*typed, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select(*typed, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counts = both.groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return _as_text(counts, keys)


def keys_only_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations of the left side that the right side lacks."""
    return key_presence(left, right, keys).filter("n_right = 0").select(*keys)


def keys_only_right(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations of the right side that the left side lacks."""
    return key_presence(left, right, keys).filter("n_left = 0").select(*keys)


def keys_common(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations present on both sides."""
    return key_presence(left, right, keys).filter("n_left > 0 AND n_right > 0").select(*keys)


def ignored_key_frame(df: DataFrame, keys: Sequence[str], ignore: Sequence[Mapping[str, object]]) -> DataFrame:
    """Ignored keys as a small DataFrame of text; an entry without a key column is an error."""
    for entry in ignore:
        missing = [k for k in keys if k not in entry]
        if missing:
            raise ValueError(f"ignored key {dict(entry)} lacks {missing}")
    rows = [tuple(None if e[k] is None else str(e[k]) for k in keys) for e in ignore]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"`{k}` string" for k in keys))


def _ignored(df: DataFrame, spec: CompareSpec) -> DataFrame | None:
    if spec.ignore_keys is None:
        return None
    if isinstance(spec.ignore_keys, DataFrame):
        return spec.ignore_keys.select(*[F.col(k).cast("string").alias(k) for k in spec.keys]).distinct()
    if not spec.ignore_keys:
        return None
    frame = ignored_key_frame(df, spec.keys, spec.ignore_keys).distinct()
    return F.broadcast(frame) if len(spec.ignore_keys) <= IGNORE_BROADCAST_ROWS else frame


def drop_ignored_keys(df: DataFrame, spec: CompareSpec) -> DataFrame:
    """Rows whose key (compared as text) is not on the ignore list."""
    ignored = _ignored(df, spec)
    if ignored is None:
        return df
    text = df.select("*", *[F.col(k).cast("string").alias(f"_t_{k}") for k in spec.keys])
    renamed = ignored.select(*[F.col(k).alias(f"_t_{k}") for k in spec.keys])
    return join_on(text, renamed, [f"_t_{k}" for k in spec.keys], "left_anti").select(*df.columns)


def pair_by_key(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """One row per key: counts, first row of each side as structs, and the ignore flag.

    The first row is the smallest by ``spec.order``, then by the compared columns.
    A NULL key is a key like any other.
    """
    columns = compared_columns(left, right, spec)
    types = {c: common_type(left.schema[c].dataType, right.schema[c].dataType) for c in columns}
    key_types = _key_types(left, right, spec.keys)
    lead = [o for o in spec.order if o not in columns]
    ordered = [*[o for o in spec.order if o in columns], *[c for c in columns if c not in spec.order]]
    empty = {k: F.lit("" if isinstance(t, T.StringType) else 0).cast(t) for k, t in key_types.items()}

    def side(df: DataFrame, row: str, count: str) -> DataFrame:
        # NULL keys are told apart by a bit mask, so that a plain equi-join pairs them too
        nulls = reduce(add, [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(spec.keys)])
        values = [F.col(c).alias(f"_o_{c}") for c in lead] + [comparable(F.col(c), df.schema[c].dataType, types[c]).alias(c) for c in ordered]
        return (
            df.select(
                *[F.coalesce(F.col(k).cast(key_types[k]), empty[k]).alias(k) for k in spec.keys],
                nulls.alias("_nulls"),
                F.struct(*values).alias("_row"),
            )
            .groupBy(*spec.keys, "_nulls")
            .agg(F.count(F.lit(1)).alias(count), F.min("_row").alias(row))
        )

    none = F.lit(0).cast("long")
    joined = side(left, "l", "n_left").join(side(right, "r", "n_right"), [*spec.keys, "_nulls"], "full_outer")
    pairs = joined.select(
        *[F.when(F.col("_nulls").bitwiseAND(1 << i) == 0, F.col(k)).alias(k) for i, k in enumerate(spec.keys)],
        F.coalesce("n_left", none).alias("n_left"),
        F.coalesce("n_right", none).alias("n_right"),
        "l",
        "r",
    )
    ignored = _ignored(left, spec)
    if ignored is None:
        return pairs.withColumn("ignored", F.lit(False))
    text = [f"_t_{k}" for k in spec.keys]
    listed = ignored.select(*[F.col(k).alias(f"_t_{k}") for k in spec.keys], F.lit(True).alias("_hit"))
    flagged = pairs.select("*", *[F.col(k).cast("string").alias(f"_t_{k}") for k in spec.keys])
    return join_on(flagged, listed, text, "left").select(*pairs.columns, F.col("_hit").isNotNull().alias("ignored"))


def _matched(pairs: DataFrame) -> DataFrame:
    return pairs.filter("n_left > 0 AND n_right > 0 AND NOT ignored")


def _cells(columns: Sequence[str], extra: Sequence[Column]) -> Column:
    """Array of (column, left, right, …) for the differing cells of a pair."""
    cells = [
        F.when(
            differs(F.col(f"l.{c}"), F.col(f"r.{c}")),
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"l.{c}").cast("string").alias("left_value"),
                F.col(f"r.{c}").cast("string").alias("right_value"),
                *extra,
            ),
        )
        for c in columns
    ]
    return F.array_compact(F.array(*cells))


def _diff_of(pairs: DataFrame, spec: CompareSpec, columns: Sequence[str]) -> DataFrame:
    return (
        _matched(pairs)
        .select(*spec.keys, F.explode(_cells(columns, [])).alias("_cell"))
        .select(*spec.keys, "_cell.column", "_cell.left_value", "_cell.right_value")
    )


def cell_diff(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """Every differing cell of the matched keys: key as text, column, left and right value."""
    return _as_text(_diff_of(pair_by_key(left, right, spec), spec, compared_columns(left, right, spec)), spec.keys)


def mismatch_counts(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """Number of differing cells per compared column, zeros included.

    Exact numbers are compared exactly with each other. Against a float or double they are compared as doubles, so
    whole numbers beyond 2^53 that fall on the same double count as equal.
    """
    columns = compared_columns(left, right, spec)
    sums = [
        F.count_if(differs(F.col(f"l.{c}"), F.col(f"r.{c}"))).alias(f"c{i}") for i, c in enumerate(columns)
    ]
    totals = _matched(pair_by_key(left, right, spec)).agg(*sums)
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("mismatches"))
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def mismatch_pairs(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """Per column and (left, right) value pair: how often it occurs and the smallest key."""
    example = F.min(F.struct(*spec.keys)).alias("_key")
    cells = _diff_of(pair_by_key(left, right, spec), spec, compared_columns(left, right, spec))
    grouped = (
        cells.groupBy("column", "left_value", "right_value")
        .agg(F.count(F.lit(1)).alias("count"), example)
    )
    return grouped.select(
        "column",
        "left_value",
        "right_value",
        "count",
        *[F.col(f"_key.{k}").cast("string").alias(f"example_{k}") for k in spec.keys],
    )


def mismatch_samples(left: DataFrame, right: DataFrame, spec: CompareSpec, n: int = 5) -> DataFrame:
    """At most ``n`` differing cells per column, smallest keys first."""
    cells = _diff_of(pair_by_key(left, right, spec), spec, compared_columns(left, right, spec))
    return _as_text(sample_per_group(cells, ["column"], spec.keys, n), spec.keys)


def duplicate_key_counts(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """Keys held by more than one row of a side, ignored keys left out."""
    counts = drop_ignored_keys(key_presence(left, right, spec.keys), spec)
    sides = F.explode(
        F.array(
            F.struct(F.lit("left").alias("side"), F.col("n_left").alias("count")),
            F.struct(F.lit("right").alias("side"), F.col("n_right").alias("count")),
        )
    )
    return (
        counts.filter("n_left > 1 OR n_right > 1")
        .select(*spec.keys, sides.alias("_s"))
        .select("_s.side", *spec.keys, "_s.count")
        .filter("count > 1")
    )


def row_count_comparison(left: DataFrame, right: DataFrame, spec: CompareSpec) -> DataFrame:
    """Rows of each side before and after key matching, and whether they agree."""
    counts = key_presence(left, right, spec.keys)
    ignored = _ignored(left, spec)
    if ignored is not None:
        flagged = join_on(counts, ignored.withColumn("_hit", F.lit(True)), spec.keys, "left")
        matched = F.expr("n_left > 0 AND n_right > 0 AND _hit IS NULL")
    else:
        flagged, matched = counts, F.expr("n_left > 0 AND n_right > 0")
    totals = flagged.agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).alias("l"),
        F.coalesce(F.sum("n_right"), F.lit(0)).alias("r"),
        F.count_if(matched).alias("m"),
    )
    return totals.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("all rows").alias("scope"),
                    F.col("l").alias("left_rows"),
                    F.col("r").alias("right_rows"),
                    (F.col("l") == F.col("r")).alias("match"),
                ),
                F.struct(
                    F.lit("matched keys").alias("scope"),
                    F.col("m").alias("left_rows"),
                    F.col("m").alias("right_rows"),
                    F.lit(True).alias("match"),
                ),
            )
        )
    )


def _counter_rows(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Section totals from one aggregate without grouping keys."""
    matched = F.expr("n_left > 0 AND n_right > 0 AND NOT ignored")
    labels = [("rows", "left"), ("rows", "right"), ("matched", "keys"), *[("mismatch_count", c) for c in columns]]
    values = [
        F.sum("n_left"),
        F.sum("n_right"),
        F.count_if(matched),
        *[F.count_if(matched & differs(F.col(f"l.{c}"), F.col(f"r.{c}"))) for c in columns],
    ]
    totals = pairs.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(f"v{i}") for i, v in enumerate(values)])
    rows = [F.struct(F.lit(s).alias("section"), F.lit(x).alias("label"), F.col(f"v{i}").alias("n")) for i, (s, x) in enumerate(labels)]
    # without a common key all mismatch counts are 0, which says nothing
    note = F.struct(F.lit("note").alias("section"), F.lit("no common keys").alias("label"), F.col("v2").alias("n"))
    return totals.select(F.inline(F.array_compact(F.array(*rows, F.when(F.col("v2") == 0, note)))))


def _entry_rows(pairs: DataFrame, spec: CompareSpec, columns: Sequence[str]) -> DataFrame:
    """Entries of one-sided keys, duplicate keys and mismatching value pairs."""
    key_type = T.StructType([pairs.schema[k] for k in spec.keys])
    text = F.struct(*[F.col(k).cast("string").alias(k) for k in spec.keys])
    key = F.to_json(text, {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    one = F.lit(1).cast("long")

    def entry(when: Column, section: str, label: Column, n: Column = one, lv: Column = none,
              rv: Column = none, example: Column = F.lit(None)) -> Column:
        fields = {"section": F.lit(section), "label": label, "left_value": lv, "right_value": rv,
                  "n": n, "example": example.cast(key_type)}
        return F.when(when, F.struct(*[c.alias(name) for name, c in fields.items()]))

    live = ~F.col("ignored")
    matched = live & (F.col("n_left") > 0) & (F.col("n_right") > 0)
    entries = [
        entry(F.col("n_right") == 0, "only_left", key),
        entry(F.col("n_left") == 0, "only_right", key),
        entry(live & (F.col("n_left") > 1), "duplicates_left", key, F.col("n_left")),
        entry(live & (F.col("n_right") > 1), "duplicates_right", key, F.col("n_right")),
    ]
    for c in columns:
        lv, rv = F.col(f"l.{c}"), F.col(f"r.{c}")
        entries.append(
            entry(matched & differs(lv, rv), "mismatch_pair", F.lit(c), one, lv.cast("string"), rv.cast("string"), F.struct(*spec.keys))
        )
    return (
        pairs.select(F.explode(F.array_compact(F.array(*entries))).alias("_e"))
        .select("_e.*")
        .groupBy("section", "label", "left_value", "right_value")
        .agg(F.sum("n").alias("n"), F.min("example").alias("_key"))
        .withColumn(
            "example",
            F.when(
                F.col("_key").isNotNull(),
                F.to_json(
                    F.struct(*[F.col(f"_key.{k}").cast("string").alias(k) for k in spec.keys]),
                    {"ignoreNullFields": "false"},
                ),
            ),
        )
        .drop("_key")
    )


def report_rows(left: DataFrame, right: DataFrame, spec: CompareSpec, top: int | None = 20) -> DataFrame:
    """All report sections as rows (section, label, left_value, right_value, n, example).

    Totals and listed entries read the same shuffled pairs. ``top`` limits the
    entries listed per section (per column for value pairs), most frequent first;
    ``None`` lists all of them. Totals are never limited.
    """
    columns = compared_columns(left, right, spec)
    pairs = pair_by_key(left, right, spec)
    entries = _entry_rows(pairs, spec, columns)
    if top is not None:
        listed = F.when(F.col("section") == "mismatch_pair", F.col("label")).otherwise(F.lit(""))
        order = [F.col("n").desc(), F.col("label"), F.col("left_value"), F.col("right_value")]
        entries = sample_per_group(entries.withColumn("_list", listed), ["section", "_list"], order, top).drop("_list")
    return _counter_rows(pairs, columns).unionByName(entries, allowMissingColumns=True).select(
        "section", "label", "left_value", "right_value", "n", "example"
    )


def match_one_to_many(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Every left row with the right row of its id: (row_id, l, r) with both rows as structs.

    NULL ids are skipped; a right id that is not unique is an error. The unique
    right rows are stored first: their size then decides the join, and a left id
    held by many rows can be split.
    """
    for df, name in ((left, left_id), (right, right_id)):
        if name not in df.columns:
            raise ValueError(f"id column {name!r} is missing")
    id_type = common_type(left.schema[left_id].dataType, right.schema[right_id].dataType)

    def side(df: DataFrame, id_column: str, name: str) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c != id_column]).alias(name)
        row_id = comparable(F.col(id_column), df.schema[id_column].dataType, id_type)
        return df.filter(F.col(id_column).isNotNull()).select(row_id.alias("row_id"), row)

    unique = (
        side(right, right_id, "r")
        .groupBy("row_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("r").alias("r"))
        .filter(F.expr("assert_true(_n = 1, 'an id of the right side is not unique') IS NULL"))
        .drop("_n")
    )
    return side(left, left_id, "l").join(materialize(unique, "unique"), "row_id")


def compare_by_id(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Long cell diff where one right row meets every left row of the same id.

    Compared are the columns common to both sides apart from the ids.
    """
    columns = sorted({c for c in left.columns if c != left_id} & {c for c in right.columns if c != right_id})
    if not columns:
        raise ValueError("no common columns to compare")
    types = {c: common_type(left.schema[c].dataType, right.schema[c].dataType) for c in columns}

    def typed(df: DataFrame, id_column: str) -> DataFrame:
        return df.select(id_column, *[comparable(F.col(c), df.schema[c].dataType, types[c]).alias(c) for c in columns])

    return (
        match_one_to_many(typed(left, left_id), typed(right, right_id), left_id, right_id)
        .select("row_id", F.explode(_cells(columns, [])).alias("_cell"))
        .select("row_id", "_cell.column", "_cell.left_value", "_cell.right_value")
    )


def id_row_counts(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Rows with a non-NULL id on each side, and whether they agree."""
    both = left.select(F.col(left_id).isNotNull().alias("_l"), F.lit(False).alias("_r")).unionAll(
        right.select(F.lit(False).alias("_l"), F.col(right_id).isNotNull().alias("_r"))
    )
    return both.agg(F.count_if("_l").alias("left_rows"), F.count_if("_r").alias("right_rows")).withColumn(
        "match", F.col("left_rows") == F.col("right_rows")
    )


def paired_source_counts(
    left: DataFrame, right: DataFrame, source_pairs: Sequence[tuple[str, str]], source: str = "source_key"
) -> DataFrame:
    """One row per configured source pair: left key, rows left, rows right, 0 when absent."""
    spark = left.sparkSession
    pairs = spark.createDataFrame(list(source_pairs), "left_key string, right_key string")
    counts = (
        left.select(F.col(source).alias("_key"), F.lit("l").alias("_side"))
        .unionAll(right.select(F.col(source).alias("_key"), F.lit("r").alias("_side")))
        .groupBy("_key")
        .agg(F.count_if(F.col("_side") == "l").alias("_l"), F.count_if(F.col("_side") == "r").alias("_r"))
    )
    ours = counts.select(F.col("_key").alias("left_key"), F.col("_l").alias("left_rows"))
    theirs = counts.select(F.col("_key").alias("right_key"), F.col("_r").alias("right_rows"))
    return (
        pairs.join(ours, "left_key", "left")
        .join(theirs, "right_key", "left")
        .select(
            "left_key",
            "right_key",
            F.coalesce("left_rows", F.lit(0).cast("long")).alias("left_rows"),
            F.coalesce("right_rows", F.lit(0).cast("long")).alias("right_rows"),
        )
    )
