"""Bronze rows to typed, defaulted silver events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.expr import as_time, clamp, lag_seconds
from fleetlens.schemas import PAYLOAD, SILVER, align_schema

# Reading assumed when a device does not send the sensor.
DEFAULTS = {
    "rpm": 0,
    "current_amps": 0.0,
    "humidity_pct": 40.0,
    "power_factor": 0.92,
    "voltage_v": 230.0,
    "pressure_bar": 2.5,
    "flow_rate_lpm": 40.0,
}
READINGS = T.StructType([f for f in PAYLOAD.fields if f.name != "ts"])
FULL_LOAD_CPM_PER_PCT = 1.2
KW_PER_AMP = 0.365


def silver_clean(bronze: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One typed row per event that has a machine and a readable time.

    The three times may be text or timestamps; sensors a landing table lacks are NULL.

    Projection and filter only, so it runs unchanged on a stream.  A missing load
    is estimated from throughput and a missing power from the measured current
    (before its default, so an unknown current gives an unknown power).  ``keep``
    names further bronze columns to pass through, e.g. a tie-breaker.
    """
    times = {"_sent": "ts", "_queued": "iothub_enqueued_time", "_stored": "ingest_ts"}
    timed = bronze.withColumns({k: as_time(bronze, c) for k, c in times.items()})
    timed = align_schema(timed.drop(*times.values()), READINGS, keep_extra=True)
    timed = timed.withColumn("event_time", F.coalesce("_sent", "_queued"))
    values = {name: F.coalesce(name, F.lit(usual)) for name, usual in DEFAULTS.items()}
    values |= {
        "load_pct": F.coalesce(
            F.col("load_pct"), clamp(F.col("throughput_cpm") / F.lit(FULL_LOAD_CPM_PER_PCT), 0, 100)
        ),
        "power_kw": F.coalesce(F.col("power_kw"), F.col("current_amps") * F.lit(KW_PER_AMP)),
        "iothub_device_id": F.col("machine_id"),
        "enqueued_time": F.col("_queued"),
        "ingest_ts": F.col("_stored"),
        "device_to_hub_ms": lag_seconds(F.col("event_time"), F.col("_queued")) * 1000,
        "hub_to_bridge_ms": lag_seconds(F.col("_queued"), F.col("_stored")) * 1000,
    }
    columns = [values[n].alias(n) if n in values else n for n in SILVER.names]
    return timed.where("machine_id is not null and event_time is not null").select(*columns, *keep)
