"""User callbacks over Arrow batches.

Batches stay in Arrow: whole numbers with NULLs would become floats in pandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type


def apply_partitions(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """Run ``fn`` on every Arrow batch of every partition, as a table of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(pa.Table.from_batches([batch])).to_batches()

    return df.mapInArrow(run, schema)


def enrich(df: DataFrame, fn: Callable[[dict], object], name: str, data_type: str = "string", workers: int = 10) -> DataFrame:
    """Add a column with the response of ``fn`` for each record; the other columns are not touched.

    Calls within a batch run on ``workers`` threads, as they mostly wait for
    somebody else; the batch order is kept.
    """
    kind = T._parse_datatype_string(data_type)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                responses = pa.array(list(pool.map(fn, batch.to_pylist())), arrow_type)
                yield batch.append_column(name, responses)

    return df.mapInArrow(run, schema)
