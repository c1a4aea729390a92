"""A micro-batch to a sink outside Spark, partition by partition, each written once.

Every partition has a token of query, batch and partition, which the sink keeps together with the
rows.  A failing write is tried again after growing waits; if it keeps failing the error ends the
batch.  The replay deals rows to the same partitions and writes those whose token is missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ship

_REPORT = "part int, n long, attempts int"


class PartitionSink(Protocol):
    """What a sink must do.  ``write`` stores rows and token as one, or fails and stores neither."""

    def has(self, token: str) -> bool: ...

    def write(self, token: str, rows: pa.Table) -> None: ...


class FolderSink:
    """A Parquet file per partition, named by its token and moved into place when complete."""

    def __init__(self, folder: str):
        self._folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        if "://" in self._folder:
            return fs.FileSystem.from_uri(self._folder)
        return fs.LocalFileSystem(), self._folder.removeprefix("file:")

    def has(self, token: str) -> bool:
        files, root = self._open()
        return files.get_file_info(f"{root}/{token}.parquet").type == fs.FileType.File

    def write(self, token: str, rows: pa.Table) -> None:
        files, root = self._open()
        files.create_dir(root, recursive=True)
        # Hidden from readers until it is complete; two attempts at once do not share a file.
        started = f"{root}/_{token}-{time.time_ns()}"
        with files.open_output_stream(started) as out:
            pq.write_table(rows, out)
        files.move(started, f"{root}/{token}.parquet")


def write_partitions(
    batch: DataFrame,
    sink: PartitionSink,
    token: str,
    key: str,
    parts: int,
    attempts: int = 5,
    first_wait_s: float = 0.5,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Write ``batch`` to ``sink`` in ``parts`` partitions; ``part, n, attempts`` of each (0 attempts: was there).

    Rows are dealt by a hash of ``key``, so a replay makes the same partitions however the batch
    is read.  A partition is held in memory while it is written: choose ``parts`` for that.
    A key with a large share of a batch is dealt by another column, or several joined to one.
    """
    ship(batch.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{token}-{part}"
        held = [b for b in batches if b.num_rows]
        n = sum(b.num_rows for b in held)
        attempt = 0
        if held and not sink.has(name):
            rows = pa.Table.from_batches(held)
            while True:
                attempt += 1
                try:
                    sink.write(name, rows)
                    break
                except Exception:
                    if attempt >= attempts:
                        raise
                    wait(first_wait_s * 2 ** (attempt - 1))
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "attempts": pa.array([attempt], pa.int32())}
        )

    report = batch.repartition(parts, F.col(key)).mapInArrow(run, _REPORT).collect()
    return batch.sparkSession.createDataFrame(sorted(report), _REPORT)
