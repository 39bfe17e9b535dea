"""Paid calls: every distinct key is asked once, also when tasks or jobs run again.

Responses go to a ledger in shared storage as they come in, a few per file. A task that runs again first reads
what its earlier attempts have written, a job that runs again leaves out all keys the ledger holds. If an executor is lost,
at most the calls since the last file are made again. A call that raises has no response and stops the task after its
siblings' responses are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.operators.rows import join_on
from ledgerline.session import materialize
from ledgerline.sources.storage import open_folder


def ship_modules(spark: SparkSession, *files: str) -> None:
    """Send Python files (.py, .zip) to all workers, so that callbacks can import them wherever workers start."""
    spark.addArtifacts(*files, pyfile=True)


def ledger_rows(spark: SparkSession, ledger: str, schema: T.StructType) -> DataFrame | None:
    """Responses written so far, or None."""
    files, root = open_folder(ledger)
    if files.get_file_info(root).type != pafs.FileType.Directory:
        return None
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(ledger)


def enrich_once(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[dict], object],
    name: str,
    ledger: str,
    data_type: str = "string",
    workers: int = 10,
    rows_per_file: int = 100,
) -> DataFrame:
    """Add a column with the response of ``fn`` for each row's key; ``fn`` gets the key columns as a dict.

    ``ledger`` is a folder on storage that all executors reach. NULL is a key like any other.
    """
    spark = df.sparkSession
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(name, T._parse_datatype_string(data_type))])
    arrow_schema, run = to_arrow_schema(schema), uuid.uuid4().hex
    asked = df.select(*keys).distinct()
    known = ledger_rows(spark, ledger, schema)
    todo = materialize(asked if known is None else join_on(asked, known.select(*keys), keys, "left_anti"), "asked")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(ledger)
        folder = f"{root}/{run}-{TaskContext.get().partitionId():06d}"
        files.create_dir(folder, recursive=True)
        earlier = [f for f in files.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet")]
        answered = {tuple(r[k] for k in keys) for f in earlier for r in pq.read_table(f.path, filesystem=files, columns=list(keys)).to_pylist()}
        held: list[dict] = []

        def write() -> None:
            if held:
                unfinished = f"{folder}/_{uuid.uuid4().hex}"
                pq.write_table(pa.Table.from_pylist(held, arrow_schema), unfinished, filesystem=files)
                files.move(unfinished, f"{folder}/{uuid.uuid4().hex}.parquet")
                held.clear()

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                rows = [r for r in batch.to_pylist() if tuple(r[k] for k in keys) not in answered]
                for i in range(0, len(rows), rows_per_file):
                    waiting = {pool.submit(fn, r): r for r in rows[i : i + rows_per_file]}
                    failure = None
                    for done in as_completed(waiting):
                        if done.exception():
                            failure = failure or done.exception()
                        else:
                            held.append(waiting[done] | {name: done.result()})
                    write()
                    if failure:
                        raise failure
                yield pa.record_batch([pa.array([len(rows)], pa.int64())], ["calls"])

    materialize(todo.mapInArrow(call, "calls long"), "calls")
    answers = ledger_rows(spark, ledger, schema)
    return join_on(df, answers, keys, "left")
