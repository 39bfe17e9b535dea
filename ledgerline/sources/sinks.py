"""Writers: parquet, tables, delimited text, JDBC, batch callbacks."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerline.session import scratch_path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write parquet; by default an existing folder is an error."""
    df.write.mode(mode).parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "append") -> None:
    """Append to a table or overwrite it, creating it when absent."""
    df.write.mode(mode).saveAsTable(name)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType) -> bool:
    """Create an empty table when it is absent; True when it was created."""
    if spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], schema).write.saveAsTable(name)
    return True


def swap_table(df: DataFrame, name: str) -> None:
    """Replace a table by a new state that may be computed from the table itself.

    The state is written beside the table, the table is set aside, the new state takes
    its name, and only then the old one is dropped. Whatever step fails, a complete copy
    is left, and ``recover_table`` puts it in place.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").saveAsTable(f"{name}__next")
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE IF EXISTS {name}__old")
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}__old")
    spark.sql(f"ALTER TABLE {name}__next RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}__old")


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Write a table whose rows are dealt into buckets by their keys and sorted, so that joins on the keys don't move it.

    Rows of a bucket are brought together first, so every bucket is one file.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def recover_table(spark: SparkSession, name: str) -> str:
    """Finish or undo a swap that broke off: ``none``, ``restored`` or ``cleaned``.

    If the table is missing, the old state comes back. Leftovers beside a table are
    dropped: a staged state may be incomplete, an old one is no longer needed.
    Call it before the table is read again.
    """
    done = "none"
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(f"{name}__old"):
        spark.sql(f"ALTER TABLE {name}__old RENAME TO {name}")
        done = "restored"
    if spark.catalog.tableExists(name):
        for rest in (f"{name}__next", f"{name}__old"):
            if spark.catalog.tableExists(rest):
                spark.sql(f"DROP TABLE {rest}")
                done = "cleaned" if done == "none" else done
    return done


def _writable(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def export_csv(df: DataFrame, path: str, quoted: bool = True, header: bool = True, mode: str = "errorifexists") -> None:
    """CSV with a header. Quoted where needed; NULL is a bare empty field and empty text is ``""``.

    Read quoted files with ``read_own_csv``, which also takes line breaks inside quotes.
    Unquoted files can't tell NULL from empty text, nor hold separators or line breaks.
    """
    if quoted:
        spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        _writable(df).write.mode(mode).csv(path, header=header, escape='"', **spaces)
    else:
        _writable(df).write.mode(mode).csv(path, header=header, quote="", nullValue="", emptyValue="")


def export_single_csv(df: DataFrame, file: str) -> None:
    """One CSV file with one header, of any size; an existing file is an error.

    The parts are written in parallel without headers, and their bytes are then joined
    in order by the file system client, with no row passing through Python.
    """
    spark = df.sparkSession
    parts = scratch_path(spark, "parts")
    export_csv(df, parts, header=False)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, source = jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.hadoop.fs.Path(parts)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, False)
    try:
        header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n"
        out.write(bytearray(header, "utf-8"))
        for name in sorted(s.getPath().getName() for s in fs.listStatus(source)):
            if name.startswith("part-"):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
    finally:
        out.close()


#: what a delimited line can't hold as it is, and its escaped form
LINE_ESCAPES = (("\n", "\\n"), ("\r", "\\r"))


#: characters that numbers, dates, times and truth values can consist of as text
PLAIN_CHARACTERS = frozenset("0123456789+-.:eE TZaflINnrsuity")


def checked_separator(sep: str) -> str:
    """A separator that escaping can tell from its own marks: no backslash, line break, ``n`` or ``r`` in it, and not empty."""
    if not sep or set(sep) & set("\\\n\rnr"):
        raise ValueError(f"separator {sep!r} is empty or holds a backslash, a line break, 'n' or 'r'")
    return sep


def delimited_line(df: DataFrame, sep: str = "|", null_token: str = "") -> Column:
    """All columns of a row as one line; backslash, separator and line breaks are escaped by a backslash.

    Only values that hold one of these are rewritten; numbers and times can't unless the separator is of their characters.
    """
    sep = checked_separator(sep)
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)

    def field(f: T.StructField) -> Column:
        raw = F.col(f.name).cast("string")
        if isinstance(f.dataType, plain) and not set(sep) & PLAIN_CHARACTERS:
            return F.coalesce(raw, F.lit(null_token))
        text = F.replace(raw, F.lit("\\"), F.lit("\\\\"))
        text = F.replace(text, F.lit(sep), F.lit("\\" + sep))
        for char, escaped in LINE_ESCAPES:
            text = F.replace(text, F.lit(char), F.lit(escaped))
        held = reduce(or_, [F.contains(raw, F.lit(x)) for x in ("\\", sep, *[c for c, _ in LINE_ESCAPES])])
        return F.coalesce(F.when(held, text).otherwise(raw), F.lit(null_token))

    return F.concat_ws(sep, *[field(f) for f in df.schema])


def export_delimited(df: DataFrame, path: str, sep: str = "|", null_token: str = "", mode: str = "errorifexists") -> None:
    """Headerless lines, escaped; NULL is written as ``null_token``.

    No value can look like the token ``\\N``, so it keeps NULL apart from empty text.
    """
    df.select(delimited_line(df, sep, null_token).alias("value")).write.mode(mode).text(path)


def write_run_dated(df: DataFrame, base: str, run_date: datetime.date | None = None) -> None:
    """Output below ``base/run_date=MMddyyyy``; a rerun replaces only its own date."""
    day = F.current_date() if run_date is None else F.lit(run_date)
    (
        df.withColumn("run_date", F.date_format(day, "MMddyyyy"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(base)
    )


def write_jdbc(
    df: DataFrame, url: str, table: str, batchsize: int = 1000, mode: str = "overwrite",
    properties: Mapping[str, str] | None = None, connections: int | None = None,
) -> None:
    """Write a staging table over JDBC in batches, over at most ``connections`` connections."""
    options = {"url": url, "dbtable": table, "batchsize": batchsize, **(properties or {})}
    if connections:
        options["numPartitions"] = connections
    df.write.format("jdbc").options(**options).mode(mode).save()


class BatchSink(Protocol):
    """Target of one partition: batches are written, then committed, or rolled back."""

    def write(self, batch: pa.RecordBatch) -> None: ...

    def commit(self) -> None: ...

    def rollback(self) -> None: ...

    def close(self) -> None: ...


def write_partitions(df: DataFrame, open_sink: Callable[[], BatchSink], batch_rows: int = 1000) -> DataFrame:
    """Write every partition through its own sink: (partition, batches, rows).

    Batches are Arrow record batches. The write happens when the result is computed. A batch is committed before
    the next one; a failed batch is rolled back and the task fails. Spark may run
    a task again, so the sink must accept a batch twice (upsert or replace).
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink = open_sink()
        batches = rows = 0
        try:
            for frame in frames:
                for start in range(0, frame.num_rows, batch_rows):
                    batch = frame.slice(start, batch_rows)
                    try:
                        sink.write(batch)
                        sink.commit()
                    except Exception:
                        sink.rollback()
                        raise
                    batches += 1
                    rows += batch.num_rows
        finally:
            sink.close()
        if rows:
            part = TaskContext.get().partitionId()
            counts = {"partition": pa.array([part], pa.int32()), "batches": pa.array([batches]), "rows": pa.array([rows])}
            yield pa.RecordBatch.from_pydict(counts)

    return df.mapInArrow(run, "partition int, batches long, rows long")


def staged_merge(staging: DataFrame, merge: Callable[[DataFrame], DataFrame], table: str) -> None:
    """Store staging rows once, merge them into the table state, swap the table."""
    spark = staging.sparkSession
    path = scratch_path(spark, "staging")
    staging.write.parquet(path)
    swap_table(merge(spark.read.schema(staging.schema).parquet(path)), table)


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row, as a column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of differing frames with all their columns."""
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result
