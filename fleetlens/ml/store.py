"""Saved models: one folder per training run, the newest complete run wins."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NoModel(LookupError):
    """No finished training run of that kind exists."""


class ModelStore:
    """Runs under ``root/kind/run=<millis>-<id>``; a run counts once its summary is written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def new_run(self, kind: str) -> tuple[str, str]:
        run_id = f"{time.time_ns() // 1_000_000:014d}-{uuid.uuid4().hex[:8]}"
        return run_id, f"{self.root}/{kind}/run={run_id}"

    def finish(self, folder: str, run_id: str, summary: dict[str, float | str]) -> None:
        """Write the run's parameters and metrics; this makes the run visible."""
        values = [F.lit(v).alias(k) for k, v in summary.items()]
        row = self.spark.range(1).select(F.lit(run_id).alias("run_id"), *values)
        row.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")

    def runs(self, kind: str) -> list[tuple[str, str]]:
        """Finished runs, oldest first: run id and folder."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "summary/_SUCCESS")
            if fs.exists(marker):
                name = status.getPath().getName()
                found.append((name.removeprefix("run="), status.getPath().toString()))
        return sorted(found)

    def latest(self, kind: str) -> tuple[str, str]:
        found = self.runs(kind)
        if not found:
            raise NoModel(f"no finished {kind} run under {self.root}")
        return found[-1]

    def summaries(self, kind: str) -> DataFrame:
        return self.spark.read.json([f"{folder}/summary" for _, folder in self.runs(kind)])
