"""Change feed of the newest row per machine: before and after image, kind and version.

State holds one row per machine.  A batch whose newest row is newer gives one change; rows that
are older, equal or sent again give none.  A machine that has been silent for a while is dropped
from the state by a timer, which gives a ``delete`` with its last image.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetlens.streaming.jobs import AVAILABLE_NOW, ROCKSDB, Trigger, append_files, seconds_of, started_with

_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_LEAST = -(2**63)
_OUT = "key string, change string, version long, at long, before string, after string"
WATERMARK = "10 seconds"


class NewestRow(StatefulProcessor):
    """Per key the greatest ``(at, tie, image)`` so far; ``expire_us`` of silence ends it."""

    def __init__(self, expire_us: int | None):
        self._expire_us = expire_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("newest", "at long, tie long, image string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802, N803 - names of the interface
        best = None
        for frame in rows:
            for row in zip(frame["at"].tolist(), frame["tie"].tolist(), frame["image"].tolist()):
                best = row if best is None or row > best else best
        if best is None:
            return
        held = self._state.get() if self._state.exists() else None
        if held is not None and best <= tuple(held)[:3]:
            return
        version = 1 if held is None else held[3] + 1
        self._state.update((*best, version))
        if self._expire_us is not None and best[0] != _LEAST:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer((best[0] + self._expire_us) // 1000)
        change = "insert" if held is None else "update"
        yield self._row(key, change, version, best[0], None if held is None else held[2], best[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if not self._state.exists():
            return
        _, _, image, version = self._state.get()
        self._state.clear()
        yield self._row(key, "delete", version + 1, expiredTimerInfo.getExpiryTimeInMs() * 1000, image, None)

    @staticmethod
    def _row(key, change, version, at, before, after) -> pd.DataFrame:
        columns = [f.split()[0] for f in _OUT.split(", ")]
        return pd.DataFrame([(key[0], change, version, at, before, after)], columns=columns)

    def close(self) -> None:
        pass


def change_feed(
    rows: DataFrame,
    key: str = "machine_id",
    time: str = "last_event_time",
    tiebreak: str | None = None,
    expire: str | None = None,
    watermark: str = WATERMARK,
) -> DataFrame:
    """``key, change, version, changed_at, before, after`` of a stream; the images are whole rows.

    ``tiebreak`` is a whole-number column that orders rows of equal time; rows equal in that too are
    ordered by their content, so the feed does not depend on the order of arrival.  ``expire``
    (say, ``7 days``) is measured in event time.  Keys are text; rows without one are a key, too.
    The state needs the RocksDB provider, which :func:`start_change_feed` asks for.
    """
    image = T.StructType(list(rows.schema.fields))
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(_LEAST))
    tie: Column = F.lit(0).cast("long") if tiebreak is None else F.coalesce(F.col(tiebreak).cast("long"), F.lit(_LEAST))
    small = rows.select(
        F.col(key).cast("string").alias("key"),
        F.col(time).cast("timestamp").alias("_time"),
        at.alias("at"),
        tie.alias("tie"),
        F.to_json(F.struct(*rows.columns), _MICROS).alias("image"),
    )
    mode = "None"
    if expire is not None:
        small, mode = small.withWatermark("_time", watermark), "EventTime"
    processor = NewestRow(None if expire is None else seconds_of(expire) * 1_000_000)
    found = small.groupBy("key").transformWithStateInPandas(processor, _OUT, "append", mode)
    return found.select(
        F.col("key").alias(key),
        "change",
        "version",
        F.when(F.col("at") != _LEAST, F.timestamp_micros("at")).alias("changed_at"),
        F.from_json("before", image, _MICROS).alias("before"),
        F.from_json("after", image, _MICROS).alias("after"),
    )


def start_change_feed(
    rows: DataFrame, path: str, checkpoint: str, trigger: Trigger = AVAILABLE_NOW, **kwargs
) -> StreamingQuery:
    """Append the change feed of ``rows`` at ``path``, each change once."""
    with started_with(rows.sparkSession, ROCKSDB):
        return append_files(change_feed(rows, **kwargs), path, checkpoint, trigger)


def apply_feed(feed: DataFrame, key: str = "machine_id", columns: Sequence[str] | None = None) -> DataFrame:
    """The table that a whole feed leads to from an empty one: the last image of every key not deleted.

    A key that comes back after a delete starts at version 1 again, later in time.
    """
    last = F.max(F.struct("changed_at", "version", "change", "after")).alias("last")
    kept = feed.groupBy(key).agg(last).where("last.change <> 'delete'")
    names = columns or feed.schema["after"].dataType.names
    return kept.select(*[F.col(f"last.after.`{c}`").alias(c) for c in names])
