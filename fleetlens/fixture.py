"""Telemetry derived from a generic ``events`` table, for tests and benchmarks.

The derivation is one projection: it folds users into 20 machines, compresses
30 days to five hours on whole milliseconds and plants defects (missing ids,
unknown states, missing device times) by event number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.expr import iso_time
from fleetlens.schemas import PAYLOAD

TELEMETRY_SQL = """
select event_id,
 case when event_id % 211 = 0 then null when event_id % 223 = 0 then 'LINE-X'
      else concat('MC-', lpad(cast(user_id % 20 as {str}), 4, '0')) end as machine_id,
 cast(k as double) / 8 as vibration_mm_s,
 cast(40 + (k * 7 + event_id) % 60 as double) as temp_c,
 cast(case when event_id % 101 = 0 then -1 else (event_id * 13 + k) % 126 end as int) as throughput_cpm,
 case when event_id % 13 = 0 then null else cast(1700 + (event_id * 29) % 1301 as int) end as rpm,
 case when event_id % 19 = 0 then null else 3 + cast((event_id * 17 + k) % 80 as double) / 8 end as current_amps,
 case when event_id % 17 = 0 then null else cast(30 + (event_id * 3 + k) % 41 as double) end as humidity_pct,
 case when event_id % 5 = 0 then null else cast((event_id * 7) % 201 as double) / 2 end as load_pct,
 case when event_id % 7 = 0 then null else cast((event_id * 11 + k) % 64 as double) / 8 end as power_kw,
 case when event_id % 23 = 0 then null else cast(0.875 as double) end as power_factor,
 case when event_id % 29 = 0 then null else cast(220 + event_id % 21 as double) end as voltage_v,
 case when event_id % 31 = 0 then null else cast(8 + (event_id * 5) % 33 as double) / 8 end as pressure_bar,
 case when event_id % 37 = 0 then null else cast(40 + (event_id * 3) % 110 as double) end as flow_rate_lpm,
 case when event_id % 97 = 0 then 'UNKNOWN' when event_type = 'error' then 'FAULT'
      when event_type = 'signup' then 'STOPPED' else 'RUN' end as state,
 case when event_type = 'error' and event_id % 97 <> 0 then
      case event_id % 4 when 0 then 'OVERCURRENT' when 1 then 'BEARING_WEAR' when 2 then 'OVERTEMP' else 'VIBRATION' end
 end as fault_code,
 case when event_id % 11 = 0 then null else ev_ms end as device_ms,
 ev_ms + (event_id * 37) % 3000 as enqueued_ms,
 ev_ms + (event_id * 37) % 3000 + (event_id * 53 + k) % 9000 as ingest_ms
from (select *, 1704067200000 + ({us} - 1704067200000000) {div} 144000 as ev_ms, {k} as k from {events}) e
"""
SPARK_SLOTS = {
    "str": "string",
    "us": "unix_micros(cast(ts as timestamp))",
    "k": "cast(get_json_object(props,'$.k') as int)",
    "div": "div",
}
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def telemetry(events: DataFrame) -> DataFrame:
    """Sensor columns plus ``device_ms``, ``enqueued_ms``, ``ingest_ms``."""
    sql = TELEMETRY_SQL.format(events="{events}", **SPARK_SLOTS)
    return events.sparkSession.sql(sql, events=events)


def _iso(millis: str):
    return iso_time(F.timestamp_millis(F.col(millis)))


def bronze(fx: DataFrame, text: bool = True) -> DataFrame:
    """Bronze rows as the parser would write them, without the message text.

    With ``text=False`` the three times are timestamps, as in a landing table that
    stores them typed.
    """
    named = [f.name for f in PAYLOAD.fields if f.name != "ts"]
    time = _iso if text else (lambda millis: F.timestamp_millis(F.col(millis)))
    return fx.where("machine_id is not null").select(
        *named,
        F.coalesce(time("device_ms"), time("enqueued_ms")).alias("ts"),
        time("enqueued_ms").alias("iothub_enqueued_time"),
        time("ingest_ms").alias("ingest_ts"),
        "event_id",
    )


def raw_messages(fx: DataFrame, break_every: int | None = None) -> DataFrame:
    """Broker rows: JSON ``value`` and ``timestamp``; every n-th body may be cut short."""
    fields = [F.col(f.name) for f in PAYLOAD.fields if f.name != "ts"]
    body = F.to_json(F.struct(*fields, _iso("device_ms").alias("ts")))
    if break_every:
        cut = F.col("event_id") % break_every == 0
        body = F.when(cut, F.expr("concat('{\"machine_id\": \"MC-', event_id)")).otherwise(body)
    return fx.select(
        body.cast("binary").alias("value"),
        F.timestamp_millis("enqueued_ms").alias("timestamp"),
        F.timestamp_millis("ingest_ms").alias("ingested"),
        "event_id",
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")
