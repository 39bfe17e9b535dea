"""Delimited text, numbered lines and file listings."""

from __future__ import annotations

import csv
import datetime
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ledgerline.session import materialize
from ledgerline.sources.sinks import PLAIN_CHARACTERS, checked_separator

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """Delimited file with a header; types are inferred unless a schema is given.

    Quotes inside quoted fields are doubled. Pass ``multiLine=True`` for fields
    with line breaks; such files cannot be split.
    """
    reader = spark.read.options(header=True, sep=sep, escape='"').options(**options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Tab-separated file with a header."""
    return read_csv(spark, path, "\t", schema)


def read_csv_dir(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Every ``*.csv`` of a folder, quoted with ``"``, first line skipped."""
    return read_csv(spark, folder, schema=schema, quote='"', pathGlobFilter="*.csv")


def read_pipe_list(spark: SparkSession, path: str, schema: str = "ticket string, path string") -> DataFrame:
    """``a|b`` lines without a header."""
    return spark.read.schema(schema).csv(path, sep="|")


def _existing(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, int]:
    """Bytes below every path that exists, from the file system's own summary."""
    conf, found = spark._jsc.hadoopConfiguration(), {}
    for key, path in paths.items():
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        if fs.exists(place):
            found[key] = fs.getContentSummary(place).getLength()
    return found


def _source_of(paths: Mapping[str, str]) -> Column:
    """The key whose path a file is, or lies in."""
    own = plain_path(uri_path(F.col("_metadata.file_path")))
    folder = F.regexp_replace(own, "/[^/]*$", "")
    plain = {re.sub("^file:/+", "/", p.rstrip("/")): k for k, p in paths.items()}
    by_path = F.create_map(*[F.lit(x) for path, key in plain.items() for x in (path, key)])
    return F.coalesce(F.try_element_at(by_path, own), F.try_element_at(by_path, folder))


def _narrowest(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """For every text column the first of int, long, double and text that holds all its values: one aggregate."""
    kinds = ("int", "bigint", "double")
    fits = [
        F.coalesce(F.bool_and(F.col(c).isNull() | F.col(c).try_cast(k).isNotNull()), F.lit(False)).alias(f"{i}_{k}")
        for i, c in enumerate(columns)
        for k in kinds
    ]
    held = df.agg(*fits).first()
    return {c: next((k for k in kinds if held[f"{i}_{k}"]), "string") for i, c in enumerate(columns)}


def read_keyed_csvs(
    spark: SparkSession, template: str, keys: Sequence[str], text_columns: Sequence[str], infer: bool = True
) -> tuple[DataFrame | None, DataFrame]:
    """One CSV per key from a path template with ``{key}``: (all rows, status per key).

    Headers of all sources are read in one scan, and sources of one header in one more. Columns are
    read as text and typed once over all sources, so a column that one source has as number and
    another as text is text. ``text_columns`` stay text and must be in each header. The status is
    (source_key, rows, error) with the errors ``missing``, ``empty``, ``no <column>`` and ``no rows``.
    """
    paths = {k: template.format(key=k) for k in keys}
    sizes = _existing(spark, paths)
    error = {k: "missing" if k not in sizes else "empty" for k in keys if not sizes.get(k)}
    filled = {k: p for k, p in paths.items() if k not in error}
    combined = None
    if filled:
        lines = spark.read.text(list(filled.values())).select(
            _source_of(filled).alias("key"), "value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")
        )
        heads = lines.groupBy("key").agg(F.min_by("value", "at").alias("head")).collect()  # one row per source
        groups: dict[tuple[str, ...], list[str]] = {}
        for r in heads:
            names = tuple(next(csv.reader([r.head]), []))
            lacking = [c for c in text_columns if c not in names]
            if lacking:
                error[r.key] = f"no {lacking[0]}"
            else:
                groups.setdefault(names, []).append(r.key)
        for names, members in groups.items():
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            part = csv_records(spark, {k: filled[k] for k in members}, schema)
            combined = part if combined is None else combined.unionByName(part, allowMissingColumns=True)
    expected = spark.createDataFrame([(k, error.get(k)) for k in keys], "source_key string, error string")
    zero = F.lit(0).cast("long")
    if combined is None:
        return None, expected.select("source_key", zero.alias("rows"), "error")
    if infer:
        typed = _narrowest(combined, [c for c in combined.columns if c not in text_columns and c != "source_key"])
        combined = combined.select(*[F.col(c).cast(typed.get(c, "string")).alias(c) for c in combined.columns])
    counts = combined.groupBy("source_key").agg(F.count(F.lit(1)).alias("rows"))
    return combined, expected.join(counts, "source_key", "left").select(
        "source_key", F.coalesce("rows", zero).alias("rows"), F.coalesce("error", F.when(F.col("rows").isNull(), F.lit("no rows"))).alias("error")
    )


def source_status(expected: DataFrame, rows: DataFrame, source: str = "source_key") -> DataFrame:
    """Per expected source: success, rows, error. ``rows`` has one row per record read.

    If ``expected`` has an ``error`` column, as the status of ``read_keyed_csvs``, its errors stay.
    """
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("rows"))
    known = F.min("error") if "error" in expected.columns else F.lit(None).cast("string")
    joined = expected.groupBy(source).agg(known.alias("error")).join(counts, source, "left")
    found = F.coalesce("rows", F.lit(0).cast("long"))
    error = F.coalesce("error", F.when(found == 0, F.lit("no rows")))
    return joined.select(source, error.isNull().alias("success"), found.alias("rows"), error.alias("error"))


def parse_url_list(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """``url,id_column`` lines: (url, id_column, error); blank lines are skipped.

    The line is split at the first comma. ``strict`` stops at the first bad line,
    else bad lines stay with their error.
    """
    text = F.trim(F.col(column))
    parts = F.split(text, ",", 2)
    parsed = lines.filter(text != "").select(
        parts[0].alias("url"), F.get(parts, F.lit(1)).alias("id_column"), text.alias("_line")
    )
    scheme = F.try_parse_url("url", F.lit("PROTOCOL"))
    host = F.try_parse_url("url", F.lit("HOST"))
    valid = F.coalesce(scheme.isin("http", "https") & (host != ""), F.lit(False))
    error = (
        F.when(F.col("id_column").isNull(), F.lit("no comma"))
        .when(~valid, F.lit("invalid url"))
        .when(F.col("id_column") == "", F.lit("missing id column"))
    )
    checked = parsed.select("url", "id_column", error.alias("error"), "_line")
    if strict:
        message = F.concat(F.lit("bad source line: "), F.col("_line"))
        checked = checked.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(message)))
    return checked.drop("_line")


def read_url_list(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A file of ``url,id_column`` lines."""
    return parse_url_list(spark.read.text(path), strict=strict)


def list_files(spark: SparkSession, root: str, dir_prefix: str = "", name_glob: str = "ap_load_*.dat") -> DataFrame:
    """Files ``root/<prefix>*/data/*/<name>`` with size and time; contents are not read."""
    return _listing(spark.read.format("binaryFile").load(f"{root}/{dir_prefix}*/data/*/{name_glob}"))


def _listing(files: DataFrame) -> DataFrame:
    return files.select(
        "path", "length", "modificationTime", F.date_format("modificationTime", TIME_FORMAT).alias("timestamp")
    )


def recent_files(spark: SparkSession, folder: str, days: int = 2, now: datetime.datetime | None = None) -> DataFrame:
    """Files of a folder modified within the last ``days`` days."""
    since = (F.lit(now) if now else F.current_timestamp()) - F.make_dt_interval(F.lit(days))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return _listing(files).filter(F.col("modificationTime") > since)


def list_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Part files present after a write."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True)
    return files.load(path).select("path", "length")


def _placed_lines(spark: SparkSession, path: str | list[str], **options: object) -> DataFrame:
    """Text lines with their file, file time, split and position; positions rise within a split."""
    return (
        spark.read.options(**options)
        .text(path)
        .select(
            uri_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_pos"),
            F.col("value").alias("line"),
        )
    )


def first_lines(spark: SparkSession, path: str | list[str], n: int, **options: object) -> DataFrame:
    """The first ``n`` lines of every file as ``numbered_lines`` gives them, without storing the text.

    Each task keeps at most ``n`` lines per file before the shuffle.
    """
    order = Window.partitionBy("path").orderBy("_start", "_pos")
    ranked = _placed_lines(spark, path, **options).withColumn("line_no", F.row_number().over(order))
    return ranked.filter(F.col("line_no") <= n).select("path", F.col("line_no").cast("long").alias("line_no"), "line", "modified")


def last_lines(spark: SparkSession, path: str | list[str], n: int = 5, **options: object) -> DataFrame:
    """The last ``n`` lines of every file: (path, line_no, line), without storing the text.

    Each task keeps at most ``n`` lines per file; their numbers follow from one count per file.
    """
    placed = _placed_lines(spark, path, **options)
    counts = placed.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("path").orderBy(F.desc("_start"), F.desc("_pos"))
    ranked = placed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    return ranked.join(counts, "path").select("path", (F.col("_n") - F.col("_rank") + 1).alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str | list[str], **options: object) -> DataFrame:
    """Text lines with their 1-based number in the file: (path, line_no, line).

    A line's number is its position in the file split plus the lines of earlier
    splits, so a large file is numbered by many tasks. Lines are stored once with their
    split, as the splits of two reads may differ; so are the counts per split, whose size
    then decides their join. ``modified`` is the file's time, ``path`` is not URI-encoded.
    """
    lines = materialize(_placed_lines(spark, path, **options), "lines")
    earlier = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("path", "_start")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
        .select("path", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return lines.join(materialize(splits, "splits"), ["path", "_start"]).select(
        "path", (F.col("_before") + F.col("_pos") - F.col("_first") + 1).alias("line_no"), "line", "modified"
    )


def nth_field(line: Column, field: int, sep: str = "\t") -> Column:
    """Field by 1-based position, NULL when the line has fewer."""
    return F.get(F.split(line, sep), F.lit(field - 1))


def file_header_scan(lines: DataFrame, line_no: int = 2, field: int = 4) -> DataFrame:
    """Per file: one field of one line as key, the number of empty fields of that line, the file's time."""
    fields = F.split("line", "\t")
    return lines.filter(F.col("line_no") == line_no).select(
        nth_field(F.col("line"), field).alias("key"),
        "path",
        F.size(F.filter(fields, lambda f: f == "")).alias("empty_fields"),
        F.date_format("modified", TIME_FORMAT).alias("timestamp"),
    )


def extract_token(lines: DataFrame, line_no: int = 3, field: int = 6) -> DataFrame:
    """One field of one line per file; files without it are left out."""
    token = nth_field(F.col("line"), field)
    return lines.filter(F.col("line_no") == line_no).select("path", token.alias("token")).filter(F.length("token") > 0)


def tail_lines(lines: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` lines of every file, found from the file's line count."""
    last = lines.groupBy("path").agg(F.max("line_no").alias("_last"))
    return lines.join(materialize(last, "last"), "path").filter(F.col("line_no") > F.col("_last") - n).select("path", "line_no", "line")


def plain_path(path: Column) -> Column:
    """A file path without its ``file:`` scheme; other schemes stay."""
    return F.regexp_replace(path, "^file:/+", "/")


def uri_path(path: Column) -> Column:
    """A path from file metadata without URI encoding; local ones with one slash after ``file:``."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def join_tickets(tickets: DataFrame, tokens: DataFrame) -> DataFrame:
    """Ticket list (ticket, path) with the token of each file: (token, ticket, path)."""
    ours = tickets.select("ticket", plain_path(F.col("path")).alias("path"))
    theirs = tokens.select("token", plain_path(F.col("path")).alias("path"))
    return ours.join(theirs, "path").select("token", "ticket", "path")


#: one of these, not in the separator, stands for escapes while a line is split; its own occurrences are coded too
_MARKS = [chr(c) for c in range(1, 9)]
#: stands for quoted empty text while a CSV file is read
_EMPTY = "\u0001empty\u0001"


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    sep: str = "|",
    nullif_empty: bool = True,
    null_token: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every line of headerless, escaped part files, with ``_file``, ``_line`` and ``_error``.

    ``_error`` names what is wrong: another number of fields, a value that does not fit its
    column, or a NULL in ``keys``. Rows with an error have NULLs in the columns that failed.
    Escapes are those of ``export_delimited``: a backslash before the separator or itself, ``\\n`` and ``\\r``.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    sep = checked_separator(sep)
    mark = next(m for m in _MARKS if m not in sep)
    codes = ((mark, "a"), ("\\\\", "b"), ("\\" + sep, "c"), ("\\n", "d"), ("\\r", "e"))
    meaning = {"c": sep, "d": "\n", "e": "\r", "b": "\\", "a": mark}
    coded = F.col("value")
    for raw, code in codes:
        coded = F.replace(coded, F.lit(raw), F.lit(mark + code))
    escaped = F.contains("value", F.lit("\\")) | F.contains("value", F.lit(mark))
    parts = F.split(F.when(escaped, coded).otherwise(F.col("value")), re.escape(sep), -1)
    lines = spark.read.text(path).select(
        uri_path(F.col("_metadata.file_path")).alias("_file"), F.col("value").alias("_line"), parts.alias("_parts")
    )

    def text(i: int, field: T.StructField) -> Column:
        part = F.get("_parts", F.lit(i))
        if null_token is not None:
            part = F.nullif(part, F.lit(null_token))
        if isinstance(field.dataType, T.StringType) or set(sep) & PLAIN_CHARACTERS:  # other values hold no escapes
            decoded = part
            for code, raw in meaning.items():
                decoded = F.replace(decoded, F.lit(mark + code), F.lit(raw))
            part = F.when(F.contains(part, F.lit(mark)), decoded).otherwise(part)
        return F.nullif(part, F.lit("")) if nullif_empty or not isinstance(field.dataType, T.StringType) else part

    texts = lines.select("_file", "_line", F.size("_parts").alias("_n"), *[text(i, f).alias(f"_t{i}") for i, f in enumerate(fields)])
    typed = texts.select("*", *[F.col(f"_t{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
    error = F.when(F.col("_n") != len(fields), F.concat(F.lit("fields: "), F.col("_n"), F.lit(f" instead of {len(fields)}")))
    for i, f in enumerate(fields):
        error = error.when(F.col(f"_t{i}").isNotNull() & F.col(f.name).isNull(), F.lit(f"value of {f.name}"))
    for k in keys:
        error = error.when(F.col(k).isNull(), F.lit(f"no {k}"))
    return typed.select(*[f.name for f in fields], "_file", "_line", error.alias("_error"))


def import_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    sep: str = "|",
    nullif_empty: bool = True,
    null_token: str | None = None,
) -> DataFrame:
    """Headerless part files in target column order; a bad line stops the query.

    To go on with the good lines and keep the bad ones use ``read_delimited``.
    """
    rows = read_delimited(spark, path, schema, sep, nullif_empty, null_token)
    message = F.concat(F.lit("bad line, "), F.col("_error"), F.lit(": "), F.col("_line"))
    checked = rows.filter(F.when(F.col("_error").isNull(), F.lit(True)).otherwise(F.raise_error(message)))
    return checked.drop("_file", "_line", "_error")


def ledger_of(spark: SparkSession, path: str | list[str], rows: DataFrame, key: str) -> DataFrame:
    """Per input file: rows loaded, bad rows, loaded rows without a key, status; files without lines count too."""
    good = F.col("_error").isNull()
    counted = rows.groupBy(F.col("_file").alias("file")).agg(
        F.count_if(good).alias("rows_loaded"),
        F.count_if(~good).alias("bad_rows"),
        F.count_if(good & F.col(key).isNull()).alias("null_keys"),
    )
    # the session lists all files anyway before it reads them; a scan of them leaves out empty ones
    names = [(name,) for name in spark.read.text(path).inputFiles()]
    listed = spark.createDataFrame(names, "file string").select(uri_path(F.col("file")).alias("file"))
    zero = F.lit(0).cast("long")
    counts = ("rows_loaded", "bad_rows", "null_keys")
    whole = listed.join(counted, "file", "left").select("file", *[F.coalesce(c, zero).alias(c) for c in counts])
    status = F.when(F.col("bad_rows") == 0, "loaded").when(F.col("rows_loaded") == 0, "failed").otherwise("partial")
    return whole.withColumn("status", status)


def load_ledger(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = "|", **options: object) -> DataFrame:
    """The ledger of part files as ``read_delimited`` reads them; every column of every line is tested."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return ledger_of(spark, path, read_delimited(spark, path, fields, sep, **options), fields[0].name)


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Number of files, of files loaded in full and of others, and rows loaded."""
    return ledger.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == "loaded").alias("loaded"),
        F.count_if(F.col("status") != "loaded").alias("not_loaded"),
        F.coalesce(F.sum("rows_loaded"), F.lit(0)).alias("rows_loaded"),
    )


def csv_records(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType | str) -> DataFrame:
    """Several CSV sources of one schema in a single scan, each row with its ``source_key``."""
    rows = spark.read.schema(schema).csv(list(paths.values()), header=True, escape='"')
    return rows.select("*", _source_of(paths).alias("source_key"))


#: lines that are put in order together when a CSV file is read
CSV_LINES = 20_000


def _csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of quoted CSV files as ``_text``, without the header lines; a record may hold line breaks inside quotes.

    A line goes on with the record before it if the quotes before it in its file are odd in number. Their parity is
    summed within chunks of lines and over the chunks, so a file is read by as many tasks as it has splits. The lines of one
    record meet by the place of its first line. Lines are stored once, as the splits of two reads may differ.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    placed = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"),
        (quotes % 2).alias("_odd"),
        F.col("value").alias("_line"),
    )
    chunk = ["_path", "_start", "_chunk"]
    lines = materialize(placed.withColumn("_chunk", F.floor(F.col("_pos") / CSV_LINES)), "lines")
    in_chunk = Window.partitionBy(*chunk).orderBy("_pos")
    of_file = Window.partitionBy("_path").orderBy("_start", "_chunk")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy(*chunk).agg(F.sum("_odd").alias("_n"), F.min("_pos").alias("_first"))
    sums = materialize(
        sums.select(*chunk, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.first("_first").over(of_file).alias("_header")), "sums"
    )

    def begun(df: DataFrame) -> DataFrame:
        inside = (F.col("_before") + F.sum("_odd").over(in_chunk) - F.col("_odd")) % 2 == 1
        return df.join(sums, chunk).withColumn("_begun", F.when(~inside, F.col("_pos")))

    # lines at the head of a chunk may go on with the last record begun in an earlier one
    last = begun(lines.select(*chunk, "_pos", "_odd")).groupBy(*chunk).agg(F.max("_begun").alias("_last"))
    carried = materialize(last.select(*chunk, F.last("_last", ignorenulls=True).over(earlier).alias("_carried")), "carried")
    record = F.coalesce(F.last("_begun", ignorenulls=True).over(in_chunk), F.col("_carried"))
    numbered = begun(lines).join(carried, chunk).select("_pos", "_line", "_header", record.alias("_record"))
    parts = F.array_sort(F.collect_list(F.struct("_pos", "_line")))
    whole = numbered.filter(F.col("_record") != F.col("_header")).groupBy("_record").agg(parts.alias("_parts"))
    return whole.select(F.array_join(F.col("_parts._line"), "\n").alias("_text")).filter(F.col("_text") != "")


def read_own_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Files of ``export_csv``: quoted line breaks are part of a value, NULL and empty text differ.

    Large files are read by many tasks, see ``_csv_records``; every record is then parsed by itself. Spark's
    parser would make NULL of quoted empty text too, so that comes as a mark and is put back.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    options = {"escape": '"', "emptyValue": _EMPTY, "multiLine": "true", "lineSep": "\n"}
    rows = _csv_records(spark, path).select(F.from_csv("_text", plain, options).alias("_row"))
    values = [F.col(f"_row.c{i}") for i in range(len(fields))]
    return rows.select(
        *[
            (F.when(v == _EMPTY, F.lit("")).otherwise(v) if isinstance(f.dataType, T.StringType) else v).alias(f.name)
            for v, f in zip(values, fields)
        ]
    )
