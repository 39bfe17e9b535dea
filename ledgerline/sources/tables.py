"""Tables, SQL text and literal rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


def scan_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table by name, or a parquet folder by path."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df.select(*columns) if columns else df


def scan_sql(spark: SparkSession, text: str, args: Mapping[str, object] | None = None, **frames: DataFrame) -> DataFrame:
    """A query with named parameters (``:name``) and DataFrames (``{name}``)."""
    return spark.sql(text, args=dict(args) if args else None, **frames)


def scan_sql_file(spark: SparkSession, path: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """The query kept in a file, usually ``<table>.sql``."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ValueError(f"{path} holds no query")
    return scan_sql(spark, text.value.rstrip().rstrip(";"), args)


def literal_df(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Inline rows; no rows give the empty frame with the schema."""
    return spark.createDataFrame(list(rows), schema)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition: tuple[str, int, int, int] | None = None,
    properties: Mapping[str, str] | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A query or table over JDBC.

    ``partition`` is (column, lower, upper, number): the read is split into that
    many range queries. Without it one task reads the whole result.
    """
    table = f"({query}) q" if query.lstrip().lower().startswith("select") else query
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_size, **(properties or {}))
    if partition:
        column, lower, upper, number = partition
        reader = reader.options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=number
        )
    return reader.load()
