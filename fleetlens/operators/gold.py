"""Windowed machine health, OEE and short-window status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import (
    as_number,
    at_least,
    at_most,
    count_if,
    instant,
    is_fault,
    lag_seconds,
)
from fleetlens.functions.scores import ANOMALY_FLAG, window_anomaly_score, window_risk_score
from fleetlens.operators.latest import newest
from fleetlens.schemas import SENSORS

AVERAGED = ("vibration_mm_s", "temp_c", "throughput_cpm", "rpm", "current_amps", "humidity_pct")
# State → name of its time bucket.
TIME_BUCKETS = {"RUN": "run", "STOPPED": "stopped", "FAULT": "fault"}


def health_windows(silver: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Per machine and tumbling window: sensor averages, event counts, fault rate.

    All aggregates are of fixed width, so they combine before the shuffle; put
    ``withWatermark`` on the input to run it on a stream.
    """
    counts = [
        count_if(F.col("state") == state).alias(f"{name}_event_count")
        for state, name in TIME_BUCKETS.items()
    ]
    return (
        silver.groupBy("machine_id", F.window("event_time", window).alias("w"))
        .agg(
            *[F.avg(c).alias(f"avg_{c}") for c in AVERAGED],
            F.count(F.lit(1)).alias("event_count"),
            *counts,
            F.avg(as_number(is_fault())).alias("fault_rate"),
        )
        .withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")})
        .drop("w")
    )


def oee(windows: DataFrame, target_cpm: float = 100.0, window_seconds: float = 300.0) -> DataFrame:
    """Time per state, availability, performance, quality and their product.

    Events in an unknown state count in the window but in no time bucket.
    """
    events = F.greatest(F.col("event_count"), F.lit(1))
    timed = windows.withColumns(
        {
            f"time_in_{name}_s": F.col(f"{name}_event_count") / events * F.lit(float(window_seconds))
            for name in TIME_BUCKETS.values()
        }
    )
    tracked = sum((F.col(f"time_in_{n}_s") for n in TIME_BUCKETS.values()), F.lit(0.0))
    factors = timed.withColumns(
        {
            "_a": F.when(tracked > 0, F.col("time_in_run_s") / tracked).otherwise(F.lit(0.0)),
            "_p": at_most(F.col("avg_throughput_cpm") / F.lit(float(target_cpm)), 1),
            "_q": at_least(F.lit(1.0) - F.col("fault_rate"), 0),
        }
    )
    return factors.withColumns(
        {
            "availability_pct": F.col("_a") * 100.0,
            "performance_pct": F.col("_p") * 100.0,
            "quality_pct": F.col("_q") * 100.0,
            "oee_pct": F.col("_a") * F.col("_p") * F.col("_q") * 100.0,
        }
    ).drop("_a", "_p", "_q")


def anomaly_rule(windows: DataFrame) -> DataFrame:
    scored = windows.withColumn("anomaly_score", window_anomaly_score())
    return scored.withColumn("is_anomaly", F.col("anomaly_score") >= ANOMALY_FLAG)


def risk_rule(windows: DataFrame) -> DataFrame:
    score = window_risk_score(F.col("anomaly_score"), F.col("fault_rate"))
    return windows.withColumn("rule_based_risk_score", score)


HEALTH_COLUMNS = [
    "machine_id",
    "window_start",
    "window_end",
    *[f"avg_{c}" for c in AVERAGED],
    "event_count",
    *[f"time_in_{name}_s" for name in TIME_BUCKETS.values()],
    "availability_pct",
    "performance_pct",
    "quality_pct",
    "oee_pct",
    "anomaly_score",
    "is_anomaly",
    "rule_based_risk_score",
]


def machine_health_windows(
    silver: DataFrame, window_seconds: int = 300, target_cpm: float = 100.0
) -> DataFrame:
    """The full gold row: windows, OEE, rule-based anomaly and risk."""
    windows = health_windows(silver, f"{window_seconds} seconds")
    scored = risk_rule(anomaly_rule(oee(windows, target_cpm, window_seconds)))
    return scored.select(*HEALTH_COLUMNS)


STATUS_VALUES = ["state", *SENSORS, "fault_code", "iothub_device_id"]


def status_windows(
    silver: DataFrame, window: str = "10 seconds", tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """The newest event per machine and short window."""
    row = newest(STATUS_VALUES, ["event_time"], tiebreak)
    picked = silver.groupBy("machine_id", F.window("event_time", window).alias("w")).agg(
        row.alias("_row")
    )
    return picked.select(
        "machine_id",
        F.col("_row.event_time").alias("last_event_time"),
        *[f"_row.{c}" for c in (*STATUS_VALUES, *tiebreak)],
    )


def with_lag(status: DataFrame, as_of: Column | datetime | str | int) -> DataFrame:
    """Add the lag of ``last_event_time`` behind ``as_of`` in whole seconds and their ms."""
    seconds = lag_seconds(F.col("last_event_time"), instant(as_of))
    return status.withColumns(
        {
            "telemetry_lag_seconds": seconds.cast("int"),
            "telemetry_lag_ms": seconds * F.lit(1000),
        }
    )
