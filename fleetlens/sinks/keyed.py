"""Keyed Parquet table: one row per key, kept as a full copy and the changes since.

An upsert writes a folder with only the incoming rows; reading reduces the newest full copy
and the later changes to the newest row per key, and a compaction writes that as the next
full copy.  Spark writes the ``_SUCCESS`` marker last, so a folder counts only when it is
complete.  One writer at a time is assumed.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.latest import latest_by_key

_FOLDER = re.compile(r"^(change|full)=(\d{12})__(.*)$")
COMPACT_AFTER = 20  # changes that a reader merges at most before the writer compacts
KEEP_S = 3600.0  # longer than the longest read


@dataclass(frozen=True)
class Part:
    """A complete folder of the table."""

    number: int
    full: bool
    tag: str
    folder: str
    written_s: float


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def versions(self) -> list[Part]:
        """Complete folders, oldest first; a full copy follows the change it contains."""
        root, fs, jvm = self._fs()
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            named = _FOLDER.match(status.getPath().getName())
            marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if named and fs.exists(marker):
                written = fs.getFileStatus(marker).getModificationTime() / 1000.0
                folder = status.getPath().toString()
                found.append(Part(int(named[2]), named[1] == "full", named[3], folder, written))
        return sorted(found, key=lambda part: (part.number, part.full))

    @staticmethod
    def _current(parts: list[Part]) -> list[Part]:
        """The newest full copy, if any, and the changes after it."""
        fulls = [at for at, part in enumerate(parts) if part.full]
        return parts[fulls[-1] :] if fulls else parts

    def read(self) -> DataFrame | None:
        """The newest row per key, None before the first upsert."""
        parts = self._current(self.versions())
        if not parts:
            return None
        if parts[-1].full:
            return self.spark.read.parquet(parts[-1].folder)
        frames = [self.spark.read.parquet(p.folder).withColumn("_number", F.lit(p.number)) for p in parts]
        rows = reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), frames)
        return latest_by_key(rows, list(self.keys), list(self.order), ["_number"]).drop("_number")

    def upsert(self, source: DataFrame, batch_id: str | int = "manual") -> bool:
        """Insert or replace by key; returns False when this batch was published before.

        A row older than the stored one is ignored; at equal order the new row wins.
        Replaying a streaming batch (same ``batch_id``) changes nothing.
        """
        done = self.versions()
        tag = str(batch_id)
        if tag != "manual" and any(part.tag == tag for part in done):
            return False
        number = done[-1].number + 1 if done else 1
        rows = latest_by_key(source, list(self.keys), list(self.order))
        rows.write.mode("overwrite").parquet(f"{self.path}/change={number:012d}__{tag}")
        return True

    def compact(self, after: int = COMPACT_AFTER) -> bool:
        """Write a full copy once ``after`` changes have gathered; old folders stay for their readers."""
        parts = self._current(self.versions())
        if sum(not part.full for part in parts) < max(1, after):
            return False
        target = f"{self.path}/full={parts[-1].number:012d}__compact"
        self.read().write.mode("overwrite").parquet(target)
        return True

    def drop_old(self, older_than_s: float = KEEP_S) -> int:
        """Delete folders whose content a full copy has held for ``older_than_s``; returns how many.

        A folder goes by the age of the first full copy after it, not of the newest one, so a
        table that is compacted all the time stays bounded too.
        """
        _, fs, jvm = self._fs()
        parts = self.versions()
        now, replaced, old = time.time(), None, []
        for part in reversed(parts):
            if replaced is not None and now - replaced.written_s >= older_than_s:
                old.append(part)
            if part.full:
                replaced = part
        for part in reversed(old):
            fs.delete(jvm.org.apache.hadoop.fs.Path(part.folder), True)
        return len(old)


def upsert_parquet(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    batch_id: str | int = "manual",
) -> KeyedTable:
    """Upsert ``source`` into the keyed table at ``path`` and return the table."""
    table = KeyedTable(spark, path, tuple(keys), tuple(order))
    table.upsert(source, batch_id)
    return table


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a history or alert table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def publish_scores(
    scored: DataFrame, history_path: str, latest_path: str, batch_id: str | int = "manual"
) -> KeyedTable:
    """Append scores to the history and upsert the newest event of each machine.

    Only the new scores go into the published table, the history is not read again: a
    key-wise maximum over the old result and the new rows is the same thing.
    """
    append(scored, history_path)
    return upsert_parquet(
        scored.sparkSession, latest_path, scored, ["machine_id"], ["event_time"], batch_id
    )


def export_training(rows: DataFrame, path: str) -> dict[str, str]:
    """Write labelled rows as Parquet, JSON lines and CSV with header.

    The labels are worked out once; the text formats are written from the Parquet copy.
    """
    targets = {kind: f"{path}/{kind}" for kind in ("json", "csv", "parquet")}
    rows.write.mode("overwrite").parquet(targets["parquet"])
    stored = rows.sparkSession.read.schema(rows.schema).parquet(targets["parquet"])
    stored.write.mode("overwrite").json(targets["json"])
    stored.write.mode("overwrite").option("header", True).csv(targets["csv"])
    return targets
