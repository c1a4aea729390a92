"""Small helpers the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of an Arrow batch; texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: Bytes of a Parquet row group, which a writing task holds whole.
ROW_GROUP = 16 << 20


def ready(spark: SparkSession) -> None:
    """Python workers get the package and batches they can hold; tables are written in small row groups."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("parquet.block.size", ROW_GROUP)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, in a session that is ready."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls into ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def by_hash(share: float, *columns) -> Column:
    """True for about ``share`` of the values of ``columns``, however small; equal values go together."""
    place = F.xxhash64(*columns).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return place < F.lit(float(share)) if share < 1 else F.lit(True)


def give_back() -> None:
    """Return memory that is free inside this Python worker to the machine.

    Workers live on between tasks and stages; what one operator has freed would otherwise count
    against the executor while the next operator runs.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """``run``, a function over batches, whose worker gives memory back after the last batch."""

    def wrapped(frames: Iterator) -> Iterator:
        yield from run(frames)
        give_back()

    return wrapped


#: Stands for a null id where ids pass through pandas, which has no null integers.
NO_ID = -(2**63)


def known_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def real_id(doc_id: str) -> Column:
    """The inverse of ``known_id``."""
    return F.nullif(F.col(doc_id), F.lit(NO_ID)).alias(doc_id)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` has written and nothing reads any more."""
    for one in tables:
        for folder in {name.rpartition("/")[0] for name in one.inputFiles()}:
            if folder.rpartition("/")[2].startswith("fleetlens-"):
                jvm = one.sparkSession.sparkContext._jvm
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(one.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys from a sorted partition, across Arrow batches.

    Only one group is held at a time, so callers bound the size of a group, not of a
    partition.
    """
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        new = np.zeros(len(frame), dtype=bool)
        for key in keys:
            values = frame[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        first = not kept or any(kept[-1][key].iloc[-1] != frame[key].iloc[0] for key in keys)
        cuts = np.flatnonzero(new)
        if first and kept:
            yield pd.concat(kept, ignore_index=True)
            kept = []
        start = 0
        for cut in cuts:
            kept.append(frame.iloc[start:cut])
            yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0].reset_index(drop=True)
            kept, start = [], cut
        kept.append(frame.iloc[start:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def spans_text(spans) -> str:
    return ",".join(f"{start}:{end}" for start, end in spans)
