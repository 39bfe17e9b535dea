"""Composite jobs: clean for load, load and upsert, sync with archive, ingest checks."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.operators.clean import (
    CleanRules,
    TargetColumn,
    cast_by_types,
    conform_schema,
    fill_null_text,
    scrub_text,
)
from ledgerline.operators.joins import join_inner, new_keys
from ledgerline.operators.maintain import deleted_keys, upsert_non_key
from ledgerline.operators.quality import validate_counts
from ledgerline.operators.rows import join_on, replicate
from ledgerline.session import materialize
from ledgerline.sources.files import ledger_of, ledger_totals, read_delimited
from ledgerline.sources.sinks import export_delimited, recover_table, save_table, swap_table, write_parquet


def clean_rows(
    df: DataFrame, target: Sequence[TargetColumn], optional: Sequence[str] = (), rules: CleanRules = CleanRules()
) -> DataFrame:
    """Conform to the target, cast, clean the text, NULL text to empty text: one projection."""
    typed = cast_by_types(conform_schema(df, target, optional), target, rules.casts)
    return fill_null_text(scrub_text(typed, rules))


def clean_for_load(
    df: DataFrame,
    target: Sequence[TargetColumn],
    path: str,
    optional: Sequence[str] = (),
    rules: CleanRules = CleanRules(),
    sep: str = "^",
    partitions: int | None = None,
) -> None:
    """Write cleaned rows as escaped part files, in one pass over the input.

    There are as many files as the input has partitions, so they grow in number and not in
    size; ``partitions`` spreads the rows evenly over another number.
    """
    cleaned = clean_rows(df, target, optional, rules)
    export_delimited(cleaned if partitions is None else cleaned.repartition(partitions), path, sep)


@dataclass(frozen=True)
class LoadResult:
    """Landing rows, new table state, totals of the load ledger, and the lines left out with their error."""

    landing: DataFrame
    state: DataFrame
    totals: DataFrame
    rejects: DataFrame


def load_and_upsert(
    spark: SparkSession,
    path: str,
    prod: DataFrame,
    keys: Sequence[str],
    sep: str = "^",
    order: Sequence[str] = (),
) -> LoadResult:
    """Import part files into landing rows and merge them into ``prod``.

    The files are read once and the lines stored with their errors. Only good lines with a
    complete key are merged; the ledger counts these same lines, and the others are the rejects.
    """
    rows = materialize(read_delimited(spark, path, prod.schema, sep, keys=keys), "landing")
    landing = rows.filter("_error IS NULL").select(*prod.columns)
    rejects = rows.filter("_error IS NOT NULL").select("_file", "_line", "_error")
    totals = ledger_totals(ledger_of(spark, path, rows, keys[0]))
    return LoadResult(landing, upsert_non_key(prod, landing, keys, order), totals, rejects)


@dataclass(frozen=True)
class SyncTable:
    """A table to synchronise; without keys it is skipped."""

    prod: str
    landing: str
    archive: str
    keys: Sequence[str]


def sync_split(prod: DataFrame, landing: DataFrame, keys: Sequence[str], as_of: datetime.date) -> tuple[DataFrame, DataFrame]:
    """(archive rows, remaining rows) split by one stored set of deleted keys, so both always agree."""
    missing = deleted_keys(prod, landing, keys)
    gone = join_on(prod, missing, keys, "left_semi").withColumn("as_of_dt", F.lit(as_of))
    return gone, join_on(prod, missing, keys, "left_anti")


def _not_archived(spark: SparkSession, gone: DataFrame, archive: str, as_of: datetime.date) -> DataFrame:
    """Deleted rows beyond those the archive has for the date: per row value the missing number of copies."""
    if not spark.catalog.tableExists(archive):
        return gone
    there = spark.table(archive).filter(F.col("as_of_dt") == F.lit(as_of)).select(*gone.columns)
    one = F.lit(1).cast("long")
    both = gone.withColumn("_n", one).unionAll(there.withColumn("_n", -one))
    return replicate(both.groupBy(*gone.columns).agg(F.sum("_n").alias("_n")), "_n")


def sync_with_archive(spark: SparkSession, tables: Sequence[SyncTable], as_of: datetime.date) -> DataFrame:
    """Archive and delete per table: (table, status, deleted, remaining).

    The archive is written before the table is swapped, and only rows that it does not
    already hold for that date: after a failure in between, a rerun adds none again.
    Equal rows are told apart by their number, so all copies of a row are archived.
    """
    rows = []
    for t in tables:
        if not t.keys:
            rows.append((t.prod, "skipped: no key", None, None))
            continue
        recover_table(spark, t.prod)
        prod = spark.table(t.prod)
        gone, kept = sync_split(prod, spark.table(t.landing), t.keys, as_of)
        gone = materialize(gone, "gone")
        save_table(_not_archived(spark, gone, t.archive, as_of), t.archive)
        swap_table(kept, t.prod)
        rows.append((t.prod, "synced", gone.count(), spark.table(t.prod).count()))
    return spark.createDataFrame(rows, "table string, status string, deleted long, remaining long")


def ingest_validate(
    file_data: DataFrame, analytics: DataFrame, processed: DataFrame, output: str | None = None
) -> Mapping[str, DataFrame]:
    """Join records with their analytics, check counts per file, find new files."""
    joined = join_inner(file_data, analytics, ["tracking_id", "record_id"]).select(
        "file_id", "record_id", "record_notes", "record_products"
    )
    if output:
        write_parquet(joined, output, "overwrite")
    return {
        "output": joined,
        "validation": validate_counts(file_data, "file_id", "file_id_rec_count", "record_id"),
        "new_files": new_keys(joined, processed, "file_id", "tracking_id").select("file_id"),
    }
