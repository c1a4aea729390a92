"""Column contracts of the stored tables and schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def schema(spec: str) -> T.StructType:
    """``"a string, b double"`` to a StructType of nullable fields."""
    fields = (item.split() for item in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# States of the device contract and spellings of "no fault".
STATES = ("RUN", "STOPPED", "FAULT")
NO_FAULT = ("", "NONE", "NULL", "null")
FAULT_CODES = ("OVERTEMP", "VIBRATION", "OVERCURRENT", "BEARING_WEAR", "MANUAL_FAULT")

# Names, types and order of the stored columns.
PAYLOAD = schema(
    "machine_id string, vibration_mm_s double, temp_c double, throughput_cpm int, rpm int, "
    "current_amps double, humidity_pct double, load_pct double, power_kw double, "
    "power_factor double, voltage_v double, pressure_bar double, flow_rate_lpm double, "
    "state string, fault_code string, ts string"
)
BRONZE = T.StructType(
    PAYLOAD.fields
    + schema("raw_body string, iothub_enqueued_time string, ingest_ts string").fields
)
# The smallest landing table older devices fill.
BRONZE_MINIMAL = schema(
    "machine_id string, vibration_mm_s double, temp_c double, throughput_cpm int, "
    "state string, fault_code string, ts string"
)
SENSORS = [
    f.name for f in PAYLOAD.fields if f.name not in ("machine_id", "state", "fault_code", "ts")
]
SILVER = T.StructType(
    schema("event_time timestamp, machine_id string").fields
    + [PAYLOAD[name] for name in SENSORS]
    + schema(
        "state string, fault_code string, iothub_device_id string, enqueued_time timestamp, "
        "ingest_ts timestamp, device_to_hub_ms bigint, hub_to_bridge_ms bigint"
    ).fields
)
ANOMALY_SCORES = schema(
    "machine_id string, event_time timestamp, anomaly_score double, is_anomaly boolean, "
    "inference_type string, model_run_id string, scored_at timestamp"
)
HORIZON_LABELS = ("5m", "1h", "24h", "7d")
FAULT_PREDICTIONS = schema(
    "machine_id string, event_time timestamp, "
    + ", ".join(
        f"prob_fault_next_{h} double, predicted_fault_next_{h} boolean" for h in HORIZON_LABELS
    )
    + ", inference_type string, model_run_id string, scored_at timestamp"
)
SERVICE_REQUESTS = schema(
    "id string, machine_id string, priority string, request_type string, description string, "
    "requestor string, status string, created_at timestamp, updated_at timestamp"
)
MIRROR_STATUS = schema(
    "machine_id string, state string, last_event_time timestamp, telemetry_lag_ms bigint, "
    "ml_lag_ms bigint, temp_c double, vibration_mm_s double, throughput_cpm int, rpm int, "
    "current_amps double, humidity_pct double, load_pct double, power_kw double, "
    "power_factor double, voltage_v double, pressure_bar double, flow_rate_lpm double, "
    "oee_pct double, anomaly_score double, prob_fault_next_5m double"
)


def missing_columns(existing: list[str], wanted: T.StructType) -> list[T.StructField]:
    have = {name.lower() for name in existing}
    return [field for field in wanted.fields if field.name.lower() not in have]


def align_schema(df: DataFrame, wanted: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Select ``wanted`` in order; a column the input lacks becomes a typed NULL."""
    have = {name.lower(): name for name in df.columns}
    shaped = []
    for field in wanted.fields:
        known = field.name.lower() in have
        source = f"`{have[field.name.lower()]}`" if known else "null"
        shaped.append(f"cast({source} as {field.dataType.simpleString()}) as `{field.name}`")
    if keep_extra:
        named = {field.name.lower() for field in wanted.fields}
        shaped += [f"`{name}`" for low, name in have.items() if low not in named]
    return df.selectExpr(*shaped)


def ensure_table(spark: SparkSession, name: str, wanted: T.StructType) -> list[str]:
    """Create ``name`` when absent, else add the columns it lacks; returns those added."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
        return []
    added = missing_columns(spark.table(name).columns, wanted)
    if added:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
    return [f.name for f in added]
