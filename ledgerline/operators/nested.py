"""Arrays, nested rows and key-value cells, built in bounded pieces.

Whoever asks for arrays, texts or objects names the items per piece; every result has a
``piece`` column, numbered by the same rule whatever the size of a group. The long
form, one row per item, is the input itself or ``distinct_items``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.json import PERSON_ARRAY, last_named
from ledgerline.operators.rows import global_rank, join_on, pieces, replicate

def nest_rows(df: DataFrame, key: str, max_items: int, name: str = "rows") -> DataFrame:
    """All rows of a key as arrays of structs: (key, piece, rows).

    Equal rows are kept once with their number in the field ``copies``. A key
    with many different rows is split over pieces by the hash of the row.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    large = (
        counted.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > max_items)
        .select(key, F.ceil(F.col("_n") / max_items).alias("_pieces"))
    )
    piece = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_pieces")), F.lit(0).cast("long"))
    return (
        join_on(counted, large, [key], "left")
        .select(key, piece.alias("piece"), F.struct(*df.columns, "copies").alias("_row"))
        .groupBy(key, "piece")
        .agg(F.collect_list("_row").alias(name))
    )


def unnest_rows(nested: DataFrame, name: str = "rows") -> DataFrame:
    """The rows of ``nest_rows`` again, copies included."""
    return replicate(nested.select(F.explode(name).alias("_row")).select("_row.*"), "copies")


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, max_items: int, name: str = "values") -> DataFrame:
    """Sorted distinct values per key as arrays: (keys, piece, values).

    Duplicates are removed before the shuffle; a key with more than ``max_items``
    distinct values has several pieces.
    """
    single = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    return (
        pieces(single, keys, value, max_items)
        .groupBy(*keys, "piece")
        .agg(F.sort_array(F.collect_list(value)).alias(name))
    )


def distinct_elements(df: DataFrame, keys: Sequence[str], array: Column, max_items: int, name: str = "values") -> DataFrame:
    """Sorted distinct elements of the arrays of a key."""
    return distinct_values(df.select(*keys, F.explode(array).alias(name)), keys, name, max_items, name)


def joined_text(df: DataFrame, keys: Sequence[str], value: str, max_items: int, separator: str = ",", name: str = "text") -> DataFrame:
    """Values of a key joined in sorted order: (keys, piece, text).

    A piece covers ``max_items`` consecutive values; joining the pieces of a key
    in order gives the whole text. Positions come from a distributed sort.
    """
    present = df.select(*keys, value).filter(F.col(value).isNotNull())
    counted = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_copies"))
    ranked = global_rank(
        replicate(counted, "_copies"), [*[F.col(k) for k in keys], F.col(value)], "_rank"
    )
    starts = ranked.groupBy(*keys).agg(F.min("_rank").alias("_start"))
    placed = join_on(ranked, starts, keys).select(
        *keys,
        F.floor((F.col("_rank") - F.col("_start")) / max_items).alias("piece"),
        F.struct("_rank", value).alias("_item"),
    )
    texts = F.transform(F.sort_array(F.collect_list("_item")), lambda item: item[value].cast("string"))
    return placed.groupBy(*keys, "piece").agg(F.concat_ws(separator, texts).alias(name))


def distinct_items(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Long form of ``distinct_values``: (keys, position, value), positions from 1 in sorted order."""
    single = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    ranked = global_rank(single, [*[F.col(k) for k in keys], F.col(value)], "_rank")
    starts = ranked.groupBy(*keys).agg(F.min("_rank").alias("_start"))
    return join_on(ranked, starts, keys).select(*keys, (F.col("_rank") - F.col("_start") + 1).alias("position"), value)


def name_conflicts(df: DataFrame, group: str, name: str, listed: DataFrame, with_text: bool = False) -> DataFrame:
    """Every row of ``df`` once, with ``conflict``: whether its name is among those listed for its group.

    A listed name gives 'No Conflict', any other 'Conflict'; NULL equals no name and no group. The
    names behind a conflict are ``distinct_items(listed, [group], name)``. ``with_text`` writes
    them into one text, 'Conflict with a, b': ask for it only where the list of a group fits a row.
    """
    known = listed.select(F.col(group).alias("_group"), F.col(name).alias("_name")).dropna().distinct()
    found = known.withColumn("_known", F.lit(True))
    marked = df.join(found, (df[group] == found["_group"]) & (df[name] == found["_name"]), "left").drop("_group", "_name")
    text = F.lit("Conflict")
    if with_text:
        lists = known.groupBy("_group").agg(F.array_join(F.sort_array(F.collect_set("_name")), ", ").alias("_text"))
        marked = marked.join(lists, marked[group] == lists["_group"], "left").drop("_group")
        text = F.concat(F.lit("Conflict with "), F.coalesce("_text", F.lit("")))
    return marked.select(*df.columns, F.when(F.col("_known"), F.lit("No Conflict")).otherwise(text).alias("conflict"))


def named_attributes(
    df: DataFrame,
    column: str,
    names: Sequence[str],
    fields: Sequence[str] = ("age", "dob"),
    schema: str = PERSON_ARRAY,
) -> DataFrame:
    """Replace a JSON array of named objects by columns ``<name>_<field>``.

    The last object of a name wins; missing names and bad JSON give NULLs. The
    text is parsed once per row, in a projection of its own.
    """
    kept = [c for c in df.columns if c != column]
    parsed = df.select(*kept, F.from_json(column, schema).alias("_items"))
    found = parsed.select(*kept, *[last_named(F.col("_items"), n).alias(f"_{n}") for n in names])
    return found.select(*kept, *[F.col(f"_{n}.{f}").alias(f"{n}_{f}") for n in names for f in fields])


def row_cells(cells: DataFrame, row_key: str) -> DataFrame:
    """Cells (row_key, family, qualifier, value) of one row."""
    return cells.filter(F.col("row_key") == F.lit(row_key))


def cells_to_json(cells: DataFrame, order: str, max_items: int) -> DataFrame:
    """Per row key a JSON object ``family:qualifier`` → value; the last cell by ``order`` wins."""
    column = F.concat_ws(":", "family", "qualifier").alias("_column")
    latest = (
        cells.select("row_key", column, "value", order)
        .groupBy("row_key", "_column")
        .agg(F.max(F.struct(order, "value")).getField("value").alias("_value"))
    )
    entries = F.sort_array(F.collect_list(F.struct("_column", "_value")))
    return (
        pieces(latest, ["row_key"], "_column", max_items)
        .groupBy("row_key", "piece")
        .agg(F.to_json(F.map_from_entries(entries)).alias("json"))
    )
