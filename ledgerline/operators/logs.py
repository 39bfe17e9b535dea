"""Load logs: one row per table from marker, time and completion lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.values import minutes_between
from ledgerline.operators.rows import carry_forward

# The line patterns of a load log. A name ends at `>` or white space.
TABLE_MARKER = r"hivevar:tablename=([^>\s]+)"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
COMPLETION = r"Completion: (\d+) Rows loaded to "
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def log_events(lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "line", chunk_rows: int = 100_000) -> DataFrame:
    """Lines with their table and time, both carried forward within the file."""
    value = F.col(text)
    marked = lines.select(
        file,
        line_no,
        F.nullif(F.regexp_extract(value, TABLE_MARKER, 1), F.lit("")).alias("table"),
        F.try_to_timestamp(F.nullif(F.regexp_extract(value, TIMESTAMP, 0), F.lit("")), F.lit(TIME_FORMAT)).alias("time"),
        F.nullif(F.regexp_extract(value, COMPLETION, 1), F.lit("")).cast("long").alias("loaded"),
        value.rlike(TIMESTAMP).alias("timed"),
    )
    return carry_forward(marked, [file], line_no, ["table", "time"], chunk_rows)


def log_table_stats(lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "line", chunk_rows: int = 100_000) -> DataFrame:
    """Per file and table: start, end, rows loaded, minutes.

    Start is the first timed line on or after the marker; end and rows come from
    the last completion line. A table without one has no end.
    """
    events = log_events(lines, file, line_no, text, chunk_rows).filter(F.col("table").isNotNull())
    first = F.min(F.when(F.col("timed"), F.struct(line_no, "time")))
    final = F.max(F.when(F.col("loaded").isNotNull(), F.struct(line_no, "time", "loaded")))
    return (
        events.groupBy(file, "table")
        .agg(first.alias("_first"), final.alias("_final"))
        .select(
            file,
            "table",
            F.col("_first.time").alias("start_time"),
            F.col("_final.time").alias("end_time"),
            F.col("_final.loaded").alias("rows"),
        )
        .withColumn("minutes", minutes_between(F.col("start_time"), F.col("end_time")))
    )


def top_tables(stats: DataFrame, n: int = 10, ties: tuple[str, ...] = ("table",)) -> DataFrame:
    """The ``n`` tables that took longest; open tables are left out."""
    return stats.filter(F.col("minutes").isNotNull()).orderBy(F.col("minutes").desc(), *ties).limit(n)
