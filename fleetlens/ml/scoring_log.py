"""Scores of successive runs: each row once per mode, a run that is repeated adds nothing.

A run writes one folder.  Its newest event time per mode is the mark up to which that mode is
scored; marks are kept beside the scores and, should a run die between the two, worked out again
from its folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.expr import instant
from fleetlens.ml.isolation_forest import KIND, IsolationForestModel
from fleetlens.ml.store import ModelStore
from fleetlens.operators.scoring import FEATURES, MODES, anomaly_rows, drop_incomplete, score_windows
from fleetlens.plans.semantic import AsOf
from fleetlens.streaming.jobs import AVAILABLE_NOW, Trigger, query_id

_MARKS = "run string, inference_type string, mark timestamp, n long"


class ScoringLog:
    """Folder of scores (``scores/run=...``) and marks (``marks/run=...``); one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _runs(self, kind: str) -> list[str]:
        """Complete runs under ``kind``; Spark writes the marker of a folder last."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        done = [s.getPath() for s in files.listStatus(root)]
        done = [p for p in done if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.getName().removeprefix("run=") for p in done)

    def read(self) -> DataFrame | None:
        """All scores, None before the first run; only complete runs count."""
        runs = self._runs("scores")
        if not runs:
            return None
        return self.spark.read.parquet(*[f"{self.path}/scores/run={r}" for r in runs])

    def _measure(self, run: str) -> None:
        scores = self.spark.read.parquet(f"{self.path}/scores/run={run}")
        marks = scores.groupBy("inference_type").agg(F.max("event_time").alias("mark"), F.count(F.lit(1)).alias("n"))
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/run={run}")

    def marks(self) -> dict[str, datetime]:
        """Per mode the event time up to which rows are scored."""
        known = set(self._runs("marks"))
        for run in self._runs("scores"):
            if run not in known:
                self._measure(run)
        if not self._runs("marks"):
            return {}
        table = self.spark.read.schema(_MARKS).parquet(f"{self.path}/marks")
        found = table.where("mark is not null").groupBy("inference_type").agg(F.unix_micros(F.max("mark")).alias("us"))
        return {r["inference_type"]: r["us"] for r in found.collect()}

    def append(self, scored: DataFrame, run: str) -> bool:
        """Write the scores of a run and advance the marks; False when that run is there already."""
        if run in self._runs("scores"):
            return False
        scored.write.mode("overwrite").parquet(f"{self.path}/scores/run={run}")
        self._measure(run)
        return True


def after_marks(tagged: DataFrame, marks: dict[str, int]) -> DataFrame:
    """The rows whose event time lies after the mark of their mode."""
    fresh: Column = F.lit(True)
    for mode, micros in marks.items():
        fresh = F.when(F.col("inference_type") == mode, F.col("event_time") > instant(micros)).otherwise(fresh)
    return tagged.where(fresh)


def score_new(
    events: DataFrame,
    model: IsolationForestModel,
    log: ScoringLog,
    as_of: AsOf,
    run: str,
    modes: Sequence[str] = MODES,
    keep: Sequence[str] = (),
    **windows,
) -> bool:
    """Score what has come since the last run of each mode, inside the mode's look-back window."""
    rows = drop_incomplete(events, ["machine_id", "event_time", *FEATURES])
    fresh = after_marks(score_windows(rows, as_of, modes=modes, **windows), log.marks())
    return log.append(anomaly_rows(model.decision(fresh), model.run_id, instant(as_of), keep=keep), run)


def start_scoring(
    events: DataFrame,
    store: ModelStore,
    log: ScoringLog,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
    mode: str = "realtime",
    scored_at: Column | None = None,
    keep: Sequence[str] = (),
    load: Callable[[ModelStore], IsolationForestModel] = IsolationForestModel.load_latest,
) -> StreamingQuery:
    """Score a stream as it arrives, late rows too, with the newest model of ``store``.

    A model is loaded when its version appears and kept for the batches after; a replayed batch
    finds its run in the log.
    """
    loaded: dict[str, IsolationForestModel] = {}
    now = F.current_timestamp() if scored_at is None else scored_at

    def score(batch: DataFrame, batch_id: int) -> None:
        version = store.latest(KIND)[0]
        if version not in loaded:
            loaded.clear()
            loaded[version] = load(store)
        model = loaded[version]
        rows = drop_incomplete(batch, ["machine_id", "event_time", *FEATURES])
        decided = model.decision(rows.withColumn("inference_type", F.lit(mode)))
        log.append(anomaly_rows(decided, version, now, keep=keep), f"{query_id(log.spark, checkpoint)}-{batch_id}")

    return events.writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(score).start()
