"""The curated views: live telemetry, machine health, hop latency, current status.

Joins carry no broadcast hint.  A machine table can be large, so the choice is left
to Spark: from file statistics when the view is read from a stored table, else from
the measured shuffle size, with skewed partitions split when it is too big.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import (
    as_time,
    before,
    instant,
    lag_millis,
    lag_seconds,
    rows_since,
)
from fleetlens.operators.gold import HEALTH_COLUMNS, STATUS_VALUES
from fleetlens.operators.latest import latest_by_key
from fleetlens.schemas import ANOMALY_SCORES, FAULT_PREDICTIONS, HORIZON_LABELS, SENSORS, align_schema

AsOf = Column | datetime | str | int
LIVE_COLUMNS = ["event_time", "machine_id", *SENSORS, "state", "fault_code", "iothub_device_id"]
LIVE_COLUMNS_SHORT = [
    "event_time",
    "machine_id",
    "vibration_mm_s",
    "temp_c",
    "throughput_cpm",
    "state",
    "fault_code",
    "iothub_device_id",
]
SCORE_ORDER = ("scored_at", "event_time")


def telemetry_live(
    silver: DataFrame, as_of: AsOf, hours: int = 24, columns: Sequence[str] = LIVE_COLUMNS
) -> DataFrame:
    """Events of the last ``hours`` (at least one); the bound is on the stored column."""
    since = before(as_of, hours=max(1, int(hours)))
    return rows_since(silver, "event_time", since).select(*columns)


def telemetry_between(live: DataFrame, start: AsOf, end: AsOf) -> DataFrame:
    """Events between two times (both included) with their hour, newest first."""
    return (
        live.where(F.col("event_time").between(instant(start), instant(end)))
        .withColumn("event_hour", F.date_trunc("HOUR", "event_time"))
        .orderBy(F.desc("event_time"))
    )


def line_name(machine: Column) -> Column:
    """Production line of a machine id; the machine numbered 0000 is the physical one."""
    number = F.regexp_extract(machine, "^MC-([0-9]+)$", 1)
    return (
        F.when(machine == "MC-0000", F.lit("Physical Line 0000"))
        .when(number != "", F.concat(F.lit("Virtual Line "), number))
        .otherwise(F.lit("Unknown Line"))
    )


def dim_machine(silver: DataFrame) -> DataFrame:
    """One row per machine with its line; the name is worked out after the distinct."""
    return silver.select("machine_id").distinct().withColumn("line_name", line_name(F.col("machine_id")))


def with_line(df: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """``df`` with the line of its machine, from ``dim`` or, without one, by the rule ``dim`` is made by."""
    if dim is None:
        return df.withColumn("line_name", line_name(F.col("machine_id")))
    return df.join(dim.select("machine_id", "line_name"), "machine_id", "left")


def hop_latency(
    bronze: DataFrame, dim: DataFrame | None = None, hub: str = "hub", store: str = "bronze"
) -> DataFrame:
    """Per event the milliseconds device → hub → store, from the three stored times.

    ``hub`` and ``store`` name the hops, so the view can carry a site's own column names.
    """
    stages = {"device_ts": "ts", f"{hub}_ts": "iothub_enqueued_time", f"{store}_ts": "ingest_ts"}
    timed = bronze.dropna(subset=list(stages.values())).select(
        "machine_id",
        "state",
        *[as_time(bronze, column).alias(name) for name, column in stages.items()],
    )
    device, queued, stored = (F.col(name) for name in stages)
    return with_line(timed, dim).select(
        "machine_id",
        "line_name",
        "state",
        *stages,
        lag_millis(device, queued).alias(f"hop1_device_to_{hub}_ms"),
        lag_millis(queued, stored).alias(f"hop2_{hub}_to_{store}_ms"),
        lag_millis(device, stored).alias(f"total_device_to_{store}_ms"),
    )


ML_COLUMNS = [
    "anomaly_score",
    "is_anomaly",
    *[f"{kind}_fault_next_{h}" for h in HORIZON_LABELS for kind in ("prob", "predicted")],
    "anomaly_inference_type",
    "fault_inference_type",
    "anomaly_model_run_id",
    "fault_model_run_id",
    "anomaly_scored_at",
    "fault_scored_at",
    "last_ml_score_time",
]


def _latest_scores(
    scores: DataFrame, schema, order: Sequence[str], prefix: str, tiebreak: Sequence[str]
) -> DataFrame:
    known = align_schema(scores, schema, keep_extra=True)
    newest = latest_by_key(known, ["machine_id"], list(order), tiebreak)
    named = {c: f"{prefix}_{c}" for c in schema.names if c != "machine_id"}
    return newest.select(*schema.names).withColumnsRenamed(named)


def machine_health(
    gold: DataFrame,
    anomaly: DataFrame,
    fault: DataFrame,
    order: Sequence[str] = SCORE_ORDER,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Health windows with the machine's newest model scores; rule scores fill the gaps.

    The newest score goes to every window of the machine, also to old ones.  Horizon
    columns the prediction table lacks are NULL.
    """
    a = _latest_scores(anomaly, ANOMALY_SCORES, order, "a", tiebreak)
    f = _latest_scores(fault, FAULT_PREDICTIONS, order, "f", tiebreak)
    joined = gold.join(a, "machine_id", "left").join(f, "machine_id", "left")
    risk = F.coalesce("f_prob_fault_next_5m", "rule_based_risk_score")
    named = {f"f_{c}": c for c in ML_COLUMNS if "_fault_next_" in c and not c.endswith("_5m")}
    for kind, short in (("anomaly", "a"), ("fault", "f")):
        named |= {f"{short}_{c}": f"{kind}_{c}" for c in ("inference_type", "model_run_id", "scored_at")}
    chosen = {
        "anomaly_score": F.coalesce("a_anomaly_score", "anomaly_score"),
        "is_anomaly": F.coalesce("a_is_anomaly", "is_anomaly"),
        "prob_fault_next_5m": risk,
        "predicted_fault_next_5m": F.coalesce(F.col("f_predicted_fault_next_5m"), risk >= 0.5),
        "last_ml_score_time": F.greatest("a_scored_at", "f_scored_at"),
    }
    measured = [c for c in HEALTH_COLUMNS if c not in (*ML_COLUMNS, "rule_based_risk_score")]
    return joined.withColumns(chosen).withColumnsRenamed(named).select(*measured, *ML_COLUMNS)


def current_status(
    status: DataFrame,
    health: DataFrame,
    dim: DataFrame,
    as_of: AsOf,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """One row per machine: newest reading, newest health window, line and lags.

    ``telemetry_lag_*`` is the lag stored with the reading when there is one; the
    ``live_`` column is always measured at ``as_of``.  Pass ``health`` built over
    :func:`latest_windows` to attach model scores to one window per machine only.
    """
    now = instant(as_of)
    seen = latest_by_key(status, ["machine_id"], ["last_event_time"], tiebreak)
    for stored in ("telemetry_lag_seconds", "telemetry_lag_ms"):
        if stored not in seen.columns:
            seen = seen.withColumn(stored, F.lit(None).cast("bigint"))
    window = latest_by_key(health, ["machine_id"], ["window_end"])
    kpis = ["oee_pct", "availability_pct", "performance_pct", "quality_pct", *ML_COLUMNS]
    kpis.remove("is_anomaly")
    live = lag_seconds(F.col("last_event_time"), now)
    scored = lag_seconds(F.coalesce("last_ml_score_time", "last_event_time"), now)
    readings = ["last_event_time", "state", *SENSORS, "fault_code"]
    joined = seen.join(window.select("machine_id", *kpis), "machine_id", "left")
    return with_line(joined, dim).select(
        "machine_id",
        *readings,
        *kpis,
        F.coalesce("telemetry_lag_seconds", live).cast("int").alias("telemetry_lag_seconds"),
        F.coalesce("telemetry_lag_ms", live * 1000).cast("bigint").alias("telemetry_lag_ms"),
        scored.cast("int").alias("ml_lag_seconds"),
        (scored * 1000).cast("bigint").alias("ml_lag_ms"),
        lag_millis(F.col("last_event_time"), now).alias("live_telemetry_lag_ms"),
        "line_name",
    )


def latest_windows(gold: DataFrame) -> DataFrame:
    """The newest health window of each machine."""
    return latest_by_key(gold, ["machine_id"], ["window_end"])


def latest_readings(status: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest reading per machine out of the short status windows."""
    keep = ["machine_id", "last_event_time", *STATUS_VALUES]
    newest = latest_by_key(status, ["machine_id"], ["last_event_time"], tiebreak)
    return newest.select(*keep, *[c for c in newest.columns if c.startswith("telemetry_lag")])


# View → what it reads and how it is built from the frames read so far.
_VIEWS: dict[str, tuple[tuple[str, ...], Callable[[Mapping[str, DataFrame], dict], DataFrame]]] = {
    "vw_machine_telemetry_live": (
        ("silver_machine_telemetry",),
        lambda t, o: telemetry_live(t["silver_machine_telemetry"], o["as_of"], o["live_hours"]),
    ),
    "dim_machine": (
        ("silver_machine_telemetry",),
        lambda t, o: dim_machine(t["silver_machine_telemetry"]),
    ),
    "vw_machine_health": (
        ("gold_machine_health_5m", "ml_anomaly_scores", "ml_fault_predictions"),
        lambda t, o: machine_health(
            t["gold_machine_health_5m"], t["ml_anomaly_scores"], t["ml_fault_predictions"]
        ),
    ),
    "vw_pipeline_latency": (
        ("bronze_iot_telemetry", "dim_machine"),
        lambda t, o: hop_latency(t["bronze_iot_telemetry"], t["dim_machine"], o["hub"], o["store"]),
    ),
    "vw_machine_current_status": (
        (
            "gold_machine_current_status",
            "gold_machine_health_5m",
            "ml_anomaly_scores",
            "ml_fault_predictions",
            "dim_machine",
        ),
        lambda t, o: current_status(
            t["gold_machine_current_status"],
            machine_health(
                latest_windows(t["gold_machine_health_5m"]),
                t["ml_anomaly_scores"],
                t["ml_fault_predictions"],
            ),
            t["dim_machine"],
            o["as_of"],
        ),
    ),
}


def register_views(
    tables: Mapping[str, DataFrame],
    as_of: AsOf,
    live_hours: int = 24,
    hub: str = "hub",
    store: str = "bronze",
) -> list[str]:
    """Create or replace the temp views over stored ``tables``; returns their build order.

    A view given in ``tables`` (say a stored ``dim_machine``) is used as is.
    """
    options = {"as_of": as_of, "live_hours": live_hours, "hub": hub, "store": store}
    graph = {name: set(reads) for name, (reads, _) in _VIEWS.items()}
    frames, built = dict(tables), []
    for name in TopologicalSorter(graph).static_order():
        if name in frames or name not in _VIEWS:
            continue
        reads, build = _VIEWS[name]
        absent = [r for r in reads if r not in frames]
        if absent:
            raise KeyError(f"{name} needs {absent}")
        frames[name] = build(frames, options)
        built.append(name)
    for name in built:
        frames[name].createOrReplaceTempView(name)
    return built
