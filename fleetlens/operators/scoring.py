"""Scored event frames: windows to score, rule and model blend, publishing shape."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import as_number, before, instant, rows_since
from fleetlens.functions.scores import HORIZONS, blended_score, horizon_expand, rule_flag
from fleetlens.operators.latest import latest_by_key
from fleetlens.schemas import ANOMALY_SCORES, FAULT_PREDICTIONS

FEATURES = ("vibration_mm_s", "temp_c", "throughput_cpm", "rpm", "current_amps", "humidity_pct")
MODES = ("batch", "realtime")


def drop_incomplete(df: DataFrame, required: Sequence[str] = ("machine_id", "event_time")):
    """Rows in which every required column has a value."""
    return df.dropna(subset=list(required))


def score_windows(
    silver: DataFrame,
    as_of: Column | datetime | str | int,
    batch_hours: int = 24,
    realtime_minutes: int = 10,
    modes: Sequence[str] = MODES,
) -> DataFrame:
    """Events of the requested look-back windows, tagged with ``inference_type``.

    An event inside both windows appears once per mode.  The windows share one scan:
    each row lists the modes it belongs to.
    """
    since = {
        "batch": before(as_of, hours=batch_hours),
        "realtime": before(as_of, minutes=realtime_minutes),
    }
    wanted = [m for m in MODES if m in modes]
    if not wanted:
        raise ValueError(f"modes must name some of {MODES}")
    member = [F.when(F.col("event_time") >= since[m], F.lit(m)) for m in wanted]
    widest = reduce(F.least, (since[m] for m in wanted)) if len(wanted) > 1 else since[wanted[0]]
    return rows_since(silver, "event_time", widest).withColumn(
        "inference_type", F.explode(F.array_compact(F.array(*member)))
    )


def blend_score(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add rule flag, anomaly score and flag to events that carry a decision value."""
    scored = df.withColumn("rule_flag", rule_flag()).withColumn(
        "anomaly_score", blended_score(F.col(raw), F.col("rule_flag"))
    )
    return scored.withColumn("is_anomaly", F.col("anomaly_score") >= 0.7)


def anomaly_rows(
    df: DataFrame, model_run_id: str, scored_at: Column, raw: str = "raw", keep: Sequence[str] = ()
) -> DataFrame:
    """Rows of the anomaly score history."""
    tagged = blend_score(df, raw).withColumns(
        {"model_run_id": F.lit(model_run_id), "scored_at": scored_at}
    )
    return tagged.select(*ANOMALY_SCORES.names, *keep)


def prediction_rows(
    df: DataFrame,
    model_run_id: str,
    scored_at: Column,
    prob: str = "prob",
    keep: Sequence[str] = (),
    base_s: int = HORIZONS["5m"],
) -> DataFrame:
    """Rows of the fault prediction history: four horizons and their 0.5 flags.

    ``base_s`` is the horizon ``prob`` was trained for.
    """
    columns = {}
    for label, p in horizon_expand(F.col(prob), base_s).items():
        columns[f"prob_fault_next_{label}"] = p
        columns[f"predicted_fault_next_{label}"] = p >= 0.5
    columns |= {"model_run_id": F.lit(model_run_id), "scored_at": scored_at}
    return df.withColumns(columns).select(*FAULT_PREDICTIONS.names, *keep)


def latest_scores(history: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """What the history publishes: the newest scored event of each machine."""
    return latest_by_key(history, ["machine_id"], ["event_time"], tiebreak)


def last_scored(history: DataFrame) -> DataFrame:
    return history.agg(F.max("scored_at").alias("last_scored_at"))


def anomaly_stats(scored: DataFrame) -> DataFrame:
    """Per mode: rows, machines, mean score and share of anomalies."""
    return scored.groupBy("inference_type").agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.countDistinct("machine_id").alias("machines_scored"),
        F.avg("anomaly_score").alias("mean_score"),
        F.avg(as_number(F.col("is_anomaly"))).alias("anomaly_rate"),
    )


def prediction_stats(scored: DataFrame) -> DataFrame:
    """Per mode: rows, machines, mean risk of three horizons and share of high risk."""
    return scored.groupBy("inference_type").agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.countDistinct("machine_id").alias("machines_scored"),
        *[F.avg(f"prob_fault_next_{h}").alias(f"mean_risk_{h}") for h in HORIZONS if h != "1h"],
        F.avg(as_number(F.col("predicted_fault_next_5m"))).alias("high_risk_rate"),
    )


def rule_alerts(df: DataFrame, detected_at: Column | datetime | str | int) -> DataFrame:
    """Running machines that shake and run hot, as alert rows; stateless, so streams too."""
    alert = (
        (F.col("vibration_mm_s") > 8.0) & (F.col("temp_c") > 85.0) & (F.col("state") == "RUN")
    )
    return df.where(alert).select(
        "machine_id",
        "event_time",
        "vibration_mm_s",
        "temp_c",
        "rpm",
        "state",
        F.lit("streaming_anomaly").alias("alert_type"),
        instant(detected_at).alias("detected_at"),
    )
