"""Batches written once, whatever is retried: a data source writer with commit and abort.

Every task writes its partition in batches as an attempt of its own. A batch becomes part of the attempt when it is
complete; a failure takes the whole attempt back. Spark hands the receipts of the attempts that count, one per
partition, to the driver, which publishes them in one step or, when the job fails, discards all. Task retries,
speculative copies and lost executors leave one copy of every row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ledgerline.sources.storage import open_folder

RECEIPT_SCHEMA = "partition int, attempt int, batches long, rows long"


@dataclass
class Receipt(WriterCommitMessage):
    """What one finished attempt has written."""

    partition: int
    attempt: int
    batches: int
    rows: int


class Attempt(Protocol):
    """One try of writing one partition; made and used on an executor."""

    def write(self, batch: pa.RecordBatch) -> None:
        """Write a batch and make it part of the attempt, or raise and leave no trace of it."""

    def rollback(self) -> None:
        """Take back all batches of the attempt."""

    def close(self) -> None: ...


class Target(Protocol):
    """Where partitions go. ``begin`` runs on executors, the others once on the driver."""

    def begin(self, job: str, partition: int, attempt: int) -> Attempt: ...

    def publish(self, job: str, receipts: list[Receipt]) -> None: ...

    def discard(self, job: str, receipts: list[Receipt]) -> None: ...


def batches_of(frames: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, the last one shorter; only whole batches are put together."""
    held, size = [], 0
    for frame in frames:
        at = 0
        while at < frame.num_rows:
            part = frame.slice(at, rows - size)
            held.append(part)
            at, size = at + part.num_rows, size + part.num_rows
            if size == rows:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, size = [], 0
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def write_transactional(df: DataFrame, target: Target, batch_rows: int = 10_000) -> str:
    """Write every partition in batches of ``batch_rows`` and publish them together; the name of the job.

    If the job fails, nothing of it is published and the error is raised.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex

    class Writer(DataSourceArrowWriter):
        def write(self, iterator: Iterator[pa.RecordBatch]) -> Receipt:
            task = TaskContext.get()
            receipt = Receipt(task.partitionId(), task.attemptNumber(), 0, 0)
            attempt = target.begin(job, receipt.partition, receipt.attempt)
            try:
                for batch in batches_of(iterator, batch_rows):
                    attempt.write(batch)
                    receipt.batches += 1
                    receipt.rows += batch.num_rows
            except BaseException:
                attempt.rollback()
                raise
            finally:
                attempt.close()
            return receipt

        def commit(self, messages: list[Receipt | None]) -> None:
            target.publish(job, [m for m in messages if m is not None])

        def abort(self, messages: list[Receipt | None]) -> None:
            target.discard(job, [m for m in messages if m is not None])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"transactional_{job}"

        def writer(self, schema, overwrite: bool) -> Writer:
            return Writer()

    spark.dataSource.register(Source)
    df.write.format(Source.name()).mode("append").save()
    return job


class FolderAttempt:
    """Parquet files, one per batch, in a folder of the attempt; a file gets its name when it is complete."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = open_folder(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.batches = 0

    def write(self, batch: pa.RecordBatch) -> None:
        unfinished = f"{self.folder}/_unfinished"
        with self.files.open_output_stream(unfinished) as out:
            pq.write_table(pa.Table.from_batches([batch]), out)
        self.files.move(unfinished, f"{self.folder}/batch-{self.batches:06d}.parquet")
        self.batches += 1

    def rollback(self) -> None:
        self.files.delete_dir(self.folder)

    def close(self) -> None:
        pass


class FolderTarget:
    """A folder on storage that all executors reach, with one subfolder per published job.

    Attempts are written below ``_open``, which readers don't see. Publishing removes the attempts that don't count and moves
    the job's folder into sight, which is one step on file systems that rename folders.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def begin(self, job: str, partition: int, attempt: int) -> FolderAttempt:
        return FolderAttempt(f"{self.path}/_open/{job}/{partition:06d}-{attempt}")

    def publish(self, job: str, receipts: list[Receipt]) -> None:
        files, root = open_folder(self.path)
        opened = f"{root}/_open/{job}"
        files.create_dir(opened, recursive=True)
        counting = {f"{r.partition:06d}-{r.attempt}" for r in receipts}
        for found in files.get_file_info(pafs.FileSelector(opened)):
            if found.base_name not in counting:
                files.delete_dir(found.path)
        with files.open_output_stream(f"{opened}/_receipts") as out:
            for r in sorted(receipts, key=lambda r: r.partition):
                out.write((json.dumps(vars(r)) + "\n").encode())
        files.move(opened, f"{root}/{job}")

    def discard(self, job: str, receipts: list[Receipt]) -> None:
        files, root = open_folder(self.path)
        if files.get_file_info(f"{root}/_open/{job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/_open/{job}")


def read_job(spark: SparkSession, path: str, job: str, schema) -> DataFrame:
    """The rows of a published job."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path.rstrip('/')}/{job}")


def receipts(spark: SparkSession, path: str, job: str) -> DataFrame:
    """(partition, attempt, batches, rows) of a published job."""
    files, root = open_folder(path.rstrip("/"))
    with files.open_input_stream(f"{root}/{job}/_receipts") as lines:
        rows = [tuple(json.loads(x).values()) for x in lines.read().splitlines()]  # one per partition
    return spark.createDataFrame(rows, RECEIPT_SCHEMA)
