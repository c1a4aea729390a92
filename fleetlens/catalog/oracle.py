"""DuckDB SQL for the named queries, written apart from the Spark code.

Only the fixture derivation is shared.  Doubles are rounded to six digits on both
sides, after a nudge of 1e-9 that keeps last-bit differences in sums off the rounding
edge; counts are cast to BIGINT where DuckDB would widen them.
"""

from __future__ import annotations

from fleetlens.fixture import TELEMETRY_SQL

_SLOTS = {
    "str": "varchar",
    "us": "epoch_us(ts)",
    "k": "cast(json_extract_string(props,'$.k') as int)",
    "div": "//",
    "events": "events",
}
_SENSORS = (
    "vibration_mm_s, temp_c, throughput_cpm, rpm, current_amps, humidity_pct, load_pct, power_kw, "
    "power_factor, voltage_v, pressure_bar, flow_rate_lpm"
)
_ISO = "strftime(epoch_ms({}), '%Y-%m-%dT%H:%M:%S.%gZ')"


def _iso(ms: str) -> str:
    return _ISO.format(ms)


def _clamp(x: str, lo: str = "0", hi: str = "1") -> str:
    return f"(case when ({x}) is null then null else greatest({lo}::double, least({hi}::double, {x})) end)"


_LINE = """case when machine_id = 'MC-0000' then 'Physical Line 0000'
 when regexp_full_match(machine_id, 'MC-[0-9]+') then 'Virtual Line ' || substr(machine_id, 4)
 else 'Unknown Line' end"""
_FAULTY = "(coalesce(state = 'FAULT', false) or fault_code is not null)"
_RULE = """(case when vibration_mm_s > 9.5 or temp_c > 85 or current_amps > 12
 or (state = 'RUN' and throughput_cpm < 15) then 1.0 else 0.0 end)::double"""
_MODEL = "(1.0::double / (1.0::double + exp(4.0::double * ((60 - temp_c) / 40))))"


def _windows(width: str) -> str:
    return f"""select machine_id, time_bucket(interval {width}, event_time) as window_start,
 time_bucket(interval {width}, event_time) + interval {width} as window_end,
 avg(vibration_mm_s) as avg_vibration_mm_s, avg(temp_c) as avg_temp_c,
 avg(throughput_cpm) as avg_throughput_cpm, avg(rpm) as avg_rpm,
 avg(current_amps) as avg_current_amps, avg(humidity_pct) as avg_humidity_pct,
 count(*) as event_count,
 count(*) filter (state = 'RUN') as run_event_count,
 count(*) filter (state = 'STOPPED') as stopped_event_count,
 count(*) filter (state = 'FAULT') as fault_event_count,
 avg(case when {_FAULTY} then 1.0::double else 0.0::double end) as fault_rate
 from silver group by all"""


def _oee(source: str, seconds: int, target: int) -> str:
    return f"""select *, a * 100 as availability_pct, p * 100 as performance_pct, q * 100 as quality_pct,
 a * p * q * 100 as oee_pct from (
 select *,
  case when time_in_run_s + time_in_stopped_s + time_in_fault_s > 0
   then time_in_run_s / (time_in_run_s + time_in_stopped_s + time_in_fault_s) else 0.0::double end as a,
  case when avg_throughput_cpm is null then null else least(avg_throughput_cpm / {target}::double, 1.0::double) end as p,
  greatest(1.0::double - fault_rate, 0.0::double) as q
 from (select *,
  run_event_count::double / event_count * {seconds} as time_in_run_s,
  stopped_event_count::double / event_count * {seconds} as time_in_stopped_s,
  fault_event_count::double / event_count * {seconds} as time_in_fault_s from {source}))"""


_GOLD_SCORE = _clamp(
    "avg_vibration_mm_s / 12::double * 0.25::double + avg_temp_c / 110::double * 0.25::double"
    " + avg_current_amps / 15::double * 0.2::double"
    " + (case when avg_throughput_cpm < 20 then 1.0::double else 0.0::double end) * 0.15::double"
    " + (case when avg_rpm > 2800 then 0.8::double else avg_rpm / 3500::double end) * 0.15::double"
)
_OEE_NUMBERS = (
    "avg_vibration_mm_s avg_temp_c avg_throughput_cpm avg_rpm avg_current_amps avg_humidity_pct "
    "time_in_run_s time_in_stopped_s time_in_fault_s availability_pct performance_pct quality_pct oee_pct"
)
_GOLD_COLUMNS = (
    "machine_id, window_start, window_end, avg_vibration_mm_s, avg_temp_c, avg_throughput_cpm, avg_rpm, "
    "avg_current_amps, avg_humidity_pct, event_count, time_in_run_s, time_in_stopped_s, time_in_fault_s, "
    "availability_pct, performance_pct, quality_pct, oee_pct"
)
_STATUS_COLUMNS = f"state, {_SENSORS}, fault_code"
_PREDICTIONS = ", ".join(
    f"prob_fault_next_{h}, predicted_fault_next_{h}" for h in ("5m", "1h", "24h", "7d")
)

_CTES = {
    "fx": TELEMETRY_SQL.format(**_SLOTS),
    "bronze": f"""select * exclude (device_ms), coalesce(device_ms, enqueued_ms) as device_ms
 from fx where machine_id is not null""",
    "silver": f"""select epoch_ms(device_ms) as event_time, machine_id, vibration_mm_s, temp_c, throughput_cpm,
 coalesce(rpm, 0) as rpm, coalesce(b.current_amps, 0)::double as current_amps,
 coalesce(humidity_pct, 40)::double as humidity_pct,
 coalesce(load_pct, {_clamp("throughput_cpm / 1.2::double", "0", "100")}) as load_pct,
 coalesce(power_kw, b.current_amps * 0.365::double) as power_kw,
 coalesce(power_factor, 0.92)::double as power_factor, coalesce(voltage_v, 230)::double as voltage_v,
 coalesce(pressure_bar, 2.5)::double as pressure_bar, coalesce(flow_rate_lpm, 40)::double as flow_rate_lpm,
 state, fault_code, machine_id as iothub_device_id, epoch_ms(enqueued_ms) as enqueued_time,
 epoch_ms(ingest_ms) as ingest_ts,
 (enqueued_ms // 1000 - device_ms // 1000) * 1000 as device_to_hub_ms,
 (ingest_ms // 1000 - enqueued_ms // 1000) * 1000 as hub_to_bridge_ms, event_id
 from bronze b""",
    "now": "select max(event_time) as t, epoch_ms(max(event_time)) as ms from silver",
    "win5": _windows("5 minute"),
    "gold0": _oee("win5", 300, 100),
    "gold": f"""select *, score >= 0.7 as is_anomaly, score as anomaly_score,
 {_clamp("score * 0.9::double + fault_rate * 0.4::double")} as rule_based_risk_score
 from (select *, {_GOLD_SCORE} as score from gold0)""",
    "status10": f"""select machine_id, event_time as last_event_time, {_STATUS_COLUMNS}, iothub_device_id, event_id,
 ((select ms from now) // 1000 - epoch_ms(event_time) // 1000)::int as telemetry_lag_seconds,
 ((select ms from now) // 1000 - epoch_ms(event_time) // 1000) * 1000 as telemetry_lag_ms
 from silver qualify row_number() over (partition by machine_id, time_bucket(interval 10 second, event_time)
 order by event_time desc, event_id desc) = 1""",
    "latest": """select * from status10
 qualify row_number() over (partition by machine_id order by last_event_time desc, event_id desc) = 1""",
    "mirror": f"""select machine_id, event_time as last_event_time, {_STATUS_COLUMNS}, iothub_device_id,
 ((select ms from now) // 1000 - epoch_ms(event_time) // 1000)::int as telemetry_lag_seconds,
 ((select ms from now) // 1000 - epoch_ms(event_time) // 1000) * 1000 as telemetry_lag_ms
 from silver where event_time <= (select t - interval 60 second from now)
 qualify row_number() over (partition by machine_id order by event_time desc, event_id desc) = 1""",
    "scorable": f"""select *, {_RULE} as rule_flag,
 {_clamp(f"{_MODEL} * 0.7::double + {_RULE} * 0.3::double")} as anomaly_score
 from silver""",
    "anomaly": """select machine_id, event_time, anomaly_score, anomaly_score >= 0.7 as is_anomaly,
 'batch' as inference_type, 'fixture' as model_run_id, (select t from now) as scored_at, event_id
 from scorable""",
    "fault": f"""select machine_id, event_time, p as prob_fault_next_5m, p >= 0.5 as predicted_fault_next_5m,
 1 - pow(1 - p, 12) as prob_fault_next_1h, 1 - pow(1 - p, 12) >= 0.5 as predicted_fault_next_1h,
 1 - pow(1 - p, 288) as prob_fault_next_24h, 1 - pow(1 - p, 288) >= 0.5 as predicted_fault_next_24h,
 1 - pow(1 - p, 2016) as prob_fault_next_7d, 1 - pow(1 - p, 2016) >= 0.5 as predicted_fault_next_7d,
 'batch' as inference_type, 'fixture' as model_run_id, (select t from now) as scored_at, event_id
 from (select *, {_clamp("anomaly_score * 0.9::double + (case when state = 'FAULT' then 0.1::double else 0.0::double end)")} as p
 from scorable)""",
    "a1": """select * from anomaly
 qualify row_number() over (partition by machine_id order by scored_at desc, event_time desc, event_id desc) = 1""",
    "f1": """select * from fault
 qualify row_number() over (partition by machine_id order by scored_at desc, event_time desc, event_id desc) = 1""",
    "dim": f"select distinct machine_id, {_LINE} as line_name from silver",
    "health": """select g.machine_id, window_start, window_end, avg_vibration_mm_s, avg_temp_c, avg_throughput_cpm,
 avg_rpm, avg_current_amps, avg_humidity_pct, event_count, time_in_run_s, time_in_stopped_s, time_in_fault_s,
 availability_pct, performance_pct, quality_pct, oee_pct,
 coalesce(a1.anomaly_score, g.anomaly_score) as anomaly_score,
 coalesce(a1.is_anomaly, g.is_anomaly) as is_anomaly,
 coalesce(f1.prob_fault_next_5m, rule_based_risk_score) as prob_fault_next_5m,
 coalesce(f1.predicted_fault_next_5m, coalesce(f1.prob_fault_next_5m, rule_based_risk_score) >= 0.5) as predicted_fault_next_5m,
 f1.prob_fault_next_1h, f1.predicted_fault_next_1h, f1.prob_fault_next_24h, f1.predicted_fault_next_24h,
 f1.prob_fault_next_7d, f1.predicted_fault_next_7d,
 a1.inference_type as anomaly_inference_type, f1.inference_type as fault_inference_type,
 a1.model_run_id as anomaly_model_run_id, f1.model_run_id as fault_model_run_id,
 a1.scored_at as anomaly_scored_at, f1.scored_at as fault_scored_at,
 greatest(a1.scored_at, f1.scored_at) as last_ml_score_time
 from gold g left join a1 on a1.machine_id = g.machine_id left join f1 on f1.machine_id = g.machine_id""",
    "newest_health": """select * from health
 qualify row_number() over (partition by machine_id order by window_end desc) = 1""",
    "cur": f"""select s.machine_id, last_event_time, {_STATUS_COLUMNS}, oee_pct, availability_pct, performance_pct,
 quality_pct, anomaly_score, {_PREDICTIONS}, anomaly_inference_type, fault_inference_type,
 anomaly_model_run_id, fault_model_run_id, anomaly_scored_at, fault_scored_at, last_ml_score_time,
 telemetry_lag_seconds, telemetry_lag_ms,
 ((select ms from now) // 1000 - epoch_ms(coalesce(last_ml_score_time, last_event_time)) // 1000)::int as ml_lag_seconds,
 ((select ms from now) // 1000 - epoch_ms(coalesce(last_ml_score_time, last_event_time)) // 1000) * 1000 as ml_lag_ms,
 (select ms from now) - epoch_ms(last_event_time) as live_telemetry_lag_ms, line_name
 from latest s left join newest_health h on h.machine_id = s.machine_id
 left join dim d on d.machine_id = s.machine_id""",
    "hops": """select b.machine_id, line_name, state, epoch_ms(device_ms) as device_ts,
 epoch_ms(enqueued_ms) as hub_ts, epoch_ms(ingest_ms) as bronze_ts,
 enqueued_ms - device_ms as hop1_device_to_hub_ms, ingest_ms - enqueued_ms as hop2_hub_to_bronze_ms,
 ingest_ms - device_ms as total_device_to_bronze_ms
 from bronze b left join dim d on d.machine_id = b.machine_id""",
    "requests": """select o_orderkey::varchar as id, 'MC-' || lpad((o_custkey % 20)::varchar, 4, '0') as machine_id,
 case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM'
  when '4-NOT SPECIFIED' then 'MEDIUM' when '5-LOW' then 'LOW' end as priority,
 case o_orderkey % 4 when 0 then 'PREVENTIVE' when 1 then 'CORRECTIVE' when 2 then 'INSPECTION' else 'CALIBRATION' end as request_type,
 null::varchar as description, null::varchar as requestor,
 case o_orderstatus when 'O' then 'OPEN' when 'P' then 'IN_PROGRESS' when 'F' then 'RESOLVED' end as status,
 o_orderdate as created_at, o_orderdate as updated_at from orders""",
    "serial": """select event_id, machine_id, vibration_mm_s, temp_c, throughput_cpm, state, fault_code,
 case when event_id % 41 = 0 then 'field count'
  when state = 'UNKNOWN' then 'state'
  when event_id % 43 = 0 then 'number'
  when throughput_cpm < 0 then 'negative throughput' end as reject_reason from fx""",
}
_PRELUDE = "with " + ",\n".join(f"{name} as ({sql})" for name, sql in _CTES.items()) + "\n"


def _q(sql: str, doubles: str = "") -> str:
    """The query over the common tables with the named columns rounded."""
    if doubles:
        cells = ", ".join(f"round({c} + 1e-9, 6) as {c}" for c in doubles.split())
        sql = f"select * replace ({cells}) from ({sql})"
    return _PRELUDE + sql


_COMPLETE = " and ".join(
    f"{c} is not null"
    for c in "vibration_mm_s temp_c throughput_cpm rpm current_amps humidity_pct state".split()
)
_HORIZONS = ("5m", "1h", "24h", "7d")
_P = " ".join(f"prob_fault_next_{h}" for h in _HORIZONS)
_SENSOR_DOUBLES = (
    "vibration_mm_s temp_c current_amps humidity_pct load_pct power_kw power_factor voltage_v "
    "pressure_bar flow_rate_lpm"
)
_OEE4 = "oee_pct availability_pct performance_pct quality_pct"
_HEALTH_DOUBLES = f"{_OEE_NUMBERS} anomaly_score {_P}"
_STATUS_DOUBLES = f"{_SENSOR_DOUBLES} {_OEE4} anomaly_score {_P}"
_SILVER_COLUMNS = f"""event_time, machine_id, {_SENSORS}, state, fault_code, iothub_device_id,
 enqueued_time, ingest_ts, device_to_hub_ms, hub_to_bridge_ms, event_id"""
_LIVE = f"event_time, machine_id, {_SENSORS}, state, fault_code, iothub_device_id"
_BRONZE_OUT = f"""machine_id, {_SENSORS}, state, fault_code, {_iso("device_ms")} as ts,
 {_iso("enqueued_ms")} as iothub_enqueued_time, {_iso("ingest_ms")} as ingest_ts, event_id"""
_RISK = "case when {0} >= 0.8 then 'CRITICAL' when {0} >= 0.5 then 'WATCH' else 'NORMAL' end"
_MAINTENANCE = """case when prob_fault_next_5m >= 0.8 then 'CRITICAL_NOW'
 when prob_fault_next_24h >= 0.6 then 'PLAN_24H' when prob_fault_next_7d >= 0.5 then 'PLAN_7D'
 else 'NORMAL' end"""


def _status3(column: str, over: str, warn: str, unit: str) -> str:
    return (
        f"case when {column} > {over} then 'OVER THRESHOLD (>{over}{unit})' "
        f"when {column} > {warn} then 'WARNING (>{warn}{unit})' else 'OK' end"
    )


_STATUS3 = {
    "vibration_mm_s": _status3("vibration_mm_s", "9.5", "8.0", ""),
    "temp_c": _status3("temp_c", "85", "75", "C"),
    "current_amps": _status3("current_amps", "12", "10", "A"),
}
_RULES = {
    "valid_state": "state in ('RUN', 'STOPPED', 'FAULT')",
    "non_negative_throughput": "throughput_cpm >= 0",
    "temp_reasonable": "temp_c between -20 and 250",
    "vibration_reasonable": "vibration_mm_s between 0 and 100",
    "rpm_reasonable": "rpm between 0 and 10000",
    "current_reasonable": "current_amps between 0 and 50",
    "humidity_reasonable": "humidity_pct between 0 and 100",
    "load_reasonable": "load_pct between 0 and 100",
    "power_reasonable": "power_kw between 0 and 200",
    "power_factor_reasonable": "power_factor between 0 and 1",
    "voltage_reasonable": "voltage_v between 100 and 600",
    "pressure_reasonable": "pressure_bar between 0 and 50",
    "flow_reasonable": "flow_rate_lpm between 0 and 1000",
}
_HOPS = {
    "device_to_hub_ms": "hop1_device_to_hub_ms",
    "hub_to_bronze_ms": "hop2_hub_to_bronze_ms",
    "total_ms": "total_device_to_bronze_ms",
}
_MV_HOPS = ", ".join(
    f"avg({c}) as avg_{n}, min({c}) as min_{n}, max({c}) as max_{n}, "
    + ", ".join(f"quantile_cont({c}, {q / 100}) as p{q}_{n}" for q in (50, 95, 99))
    for n, c in _HOPS.items()
)
_MV_HOPS_DOUBLES = " ".join(f"{how}_{n}" for n in _HOPS for how in ("avg", "p50", "p95", "p99"))
_SHORT = {"d2h": "hop1_device_to_hub_ms", "h2b": "hop2_hub_to_bronze_ms", "total": "total_device_to_bronze_ms"}


def _latency_stats(where: str) -> str:
    cells = ", ".join(
        f"round(avg({c}), 0) as avg_{s}_ms, max({c}) as max_{s}_ms, "
        f"round(quantile_cont({c}, 0.5), 0) as p50_{s}_ms, round(quantile_cont({c}, 0.95), 0) as p95_{s}_ms"
        for s, c in _SHORT.items()
    )
    return f"select machine_id, {cells}, count(*) as sample_count from hops where {where} group by machine_id"


_BREAKDOWN = ", ".join(
    f"round(quantile_cont({c}, 0.5), 0) as p50_{s}_ms, round(quantile_cont({c}, 0.95), 0) as p95_{s}_ms, "
    f"min({c}) as min_{s}_ms, max({c}) as max_{s}_ms, round(avg({c}), 0) as avg_{s}_ms"
    for s, c in _SHORT.items()
)
_SINCE = "(select t - interval {} from now)"
_EXPORT = f"""select unnest(['parquet', 'json', 'csv']) as format, event_time, machine_id, {_SENSORS}, state, fault_code, device_to_hub_ms, hub_to_bridge_ms, event_id,
 case when exists (select 1 from silver n where n.machine_id = s.machine_id
   and (coalesce(n.state = 'FAULT', false) or n.fault_code is not null)
   and epoch_ms(n.event_time) // 1000 between epoch_ms(s.event_time) // 1000 + 1 and epoch_ms(s.event_time) // 1000 + 300)
  then 1 else 0 end as label_fault_next_5m,
 state = 'FAULT' as is_fault,
 (temp_c >= 85 or vibration_mm_s >= 9.5 or current_amps >= 12) as threshold_crossed,
 85.0::double as temp_fault_threshold, 9.5::double as vibration_fault_threshold from silver s"""


def _future(seconds: int, name: str) -> str:
    return f"""select event_id, case when max(case when {_FAULTY} then 1 else 0 end) over (
 partition by machine_id order by epoch_ms(event_time) // 1000
 range between 1 following and {seconds} following) = 1 then 1 else 0 end as {name} from silver"""


def _both_modes(hours: int) -> str:
    return f"""select *, 'batch' as inference_type from silver where event_time >= {_SINCE.format(f"{hours} hour")}
 union all select *, 'realtime' from silver where event_time >= {_SINCE.format("10 minute")}"""


_SUMMARY = f"""select machine_id, concat('Machine ', machine_id, ': state=', coalesce(state, 'UNKNOWN'),
 ', vibration=', round(coalesce(vibration_mm_s, 0), 2)::varchar, ' mm/s [', {_STATUS3["vibration_mm_s"]}, ']',
 ', temp=', round(coalesce(temp_c, 0), 1)::varchar, 'C [', {_STATUS3["temp_c"]}, ']',
 ', current=', round(coalesce(current_amps, 0), 2)::varchar, 'A [', {_STATUS3["current_amps"]}, ']',
 ', throughput=', coalesce(throughput_cpm, 0)::varchar, ' cpm', ', rpm=', coalesce(rpm, 0)::varchar,
 ', OEE=', round(coalesce(oee_pct, 0), 1)::varchar, '%',
 ', anomaly_score=', round(coalesce(anomaly_score, 0), 3)::varchar,
 ', fault_risk_5m=', round(coalesce(prob_fault_next_5m, 0), 3)::varchar,
 ', fault_risk_1h=', round(coalesce(prob_fault_next_1h, 0), 3)::varchar) as summary from cur"""

_DERIVED = """round(greatest(0, least(100, throughput_cpm / 120::double * 100)), 2) as load_pct"""
_FROM_LOAD = """round(voltage_v * current_amps * power_factor * sqrt(3::double) / 1000, 3) as power_kw,
 round(greatest(1::double, 2.5::double + load_pct / 45), 3) as pressure_bar,
 round(greatest(5::double, 40::double + throughput_cpm * 0.95::double), 2) as flow_rate_lpm"""
_TOP = "order by {} limit {}"


def _band(column: str, cuts: str, rest: str = "NORMAL") -> str:
    return f"case when {column} is null then 'UNKNOWN' {cuts} else '{rest}' end"


_ORACLES = {
    # ---- sources and ingestion
    "bronze_parse_json": _q(f"select {_BRONZE_OUT}, machine_id as raw_body from bronze", _SENSOR_DOUBLES),
    "bronze_malformed": _q("""select count(*) as received, count(*) filter (event_id % 17 <> 0) as parsed,
 count(*) filter (event_id % 17 = 0) as malformed,
 count(*) filter (event_id % 17 <> 0 and machine_id is null) as without_machine from fx"""),
    "bronze_split": _q(
        "select event_id, case when event_id % 17 = 0 then 'bad' else 'good' end as part from fx"
    ),
    "bronze_enqueue_enrich": _q(f"""select event_id, {_iso("device_ms")} as ts,
 {_iso("enqueued_ms")} as iothub_enqueued_time, {_iso("ingest_ms")} as ingest_ts from bronze"""),
    "serial_csv_parse": _q(
        """select event_id, vibration_mm_s, temp_c, throughput_cpm, state, fault_code
 from serial where reject_reason is null""",
        "vibration_mm_s temp_c",
    ),
    "serial_csv_rejects": _q("""select reject_reason, count(*) as lines from serial
 where reject_reason is not null group by 1"""),
    "derive_metrics": _q(f"""select *, {_FROM_LOAD} from (
 select event_id, vibration_mm_s, temp_c, throughput_cpm,
 greatest(0, least(3000, throughput_cpm * 25))::int as rpm,
 round(greatest(0.5::double, least(15::double, 2::double + throughput_cpm / 120::double * 11)), 3) as current_amps,
 round(greatest(30::double, least(85::double, 30::double + (temp_c - 30) * 0.7::double)), 1) as humidity_pct,
 230::double as voltage_v, 0.92::double as power_factor, {_DERIVED}
 from serial where reject_reason is null)"""),
    "derive_metrics_measured": _q(f"""select *, {_FROM_LOAD} from (
 select event_id, throughput_cpm, temp_c, rpm, current_amps, humidity_pct,
 230::double as voltage_v, 0.92::double as power_factor, {_DERIVED} from fx)"""),
    "src_batch_table": _q("""select machine_id, event_time, vibration_mm_s, temp_c, throughput_cpm, rpm,
 current_amps, humidity_pct, state from silver"""),
    "schema_evolve": _q("""select event_time, machine_id, temp_c, state, null::int as rpm,
 null::timestamp as ingest_ts from silver"""),
    "optional_cols": _q(
        """select machine_id, event_time, prob_fault_next_5m, predicted_fault_next_5m,
 null::double as prob_fault_next_1h, null::boolean as predicted_fault_next_1h,
 null::double as prob_fault_next_24h, null::boolean as predicted_fault_next_24h,
 null::double as prob_fault_next_7d, null::boolean as predicted_fault_next_7d,
 null::varchar as inference_type, null::varchar as model_run_id, null::timestamp as scored_at, event_id
 from fault""",
        "prob_fault_next_5m",
    ),
    # ---- projections, filters, predicates
    "silver_clean": _q(f"select {_SILVER_COLUMNS} from silver", _SENSOR_DOUBLES),
    "dq_expectations": _q(
        " union all ".join(
            f"select '{rule}' as rule, count(*) filter (not coalesce({test}, false)) as violations, "
            "count(*) as rows_checked from silver"
            for rule, test in _RULES.items()
        )
    ),
    "dq_flag_rows": _q(
        "select event_id, concat_ws(',', "
        + ", ".join(
            f"case when not coalesce({test}, false) then '{rule}' end"
            for rule, test in sorted(_RULES.items())
        )
        + ") as violated from silver"
    ),
    "hop_latency_silver": _q("select event_id, device_to_hub_ms, hub_to_bridge_ms from silver"),
    "hop_latency_events": _q("select * from hops"),
    "telemetry_live": _q(
        f"select {_LIVE} from silver where event_time >= {_SINCE.format('24 hour')}", _SENSOR_DOUBLES
    ),
    "telemetry_live_2h": _q(f"""select event_time, machine_id, vibration_mm_s, temp_c, throughput_cpm, state,
 fault_code, iothub_device_id from silver where event_time >= {_SINCE.format("2 hour")}"""),
    "telemetry_between": _q(f"""select event_time, date_trunc('hour', event_time) as event_hour, machine_id, state,
 vibration_mm_s, temp_c, throughput_cpm, rpm, current_amps, humidity_pct from silver
 where event_time between {_SINCE.format("2 hour")} and {_SINCE.format("1 hour")}"""),
    "dim_machine": _q("select * from dim"),
    "risk_band": _q(f"select machine_id, {_RISK.format('prob_fault_next_5m')} as risk_band from cur"),
    "maintenance_band": _q(f"select machine_id, {_MAINTENANCE} as maintenance_band from cur"),
    "latency_status": _q("""select machine_id, device_ts, total_device_to_bronze_ms,
 case when total_device_to_bronze_ms < 10000 then '✓ <10s' when total_device_to_bronze_ms < 30000 then '⚠ 10-30s'
 else '✗ >30s' end as latency_status from hops"""),
    "sensor_status": _q(
        "select event_id, " + ", ".join(f"{e} as {c}_status" for c, e in _STATUS3.items()) + " from silver"
    ),
    "vibration_status": _q("""select event_id, case when vibration_mm_s >= 9.5 then 'FAULT'
 when vibration_mm_s >= 8 then 'WARNING' else 'NORMAL' end as vibration_status from silver"""),
    "sensor_bands": _q(
        f"""select event_id,
 {_band("vibration_mm_s", "when vibration_mm_s >= 9.5 then 'FAULT' when vibration_mm_s >= 8 then 'WARNING'")} as vibration_mm_s_band,
 {_band("temp_c", "when temp_c >= 85 then 'FAULT' when temp_c >= 75 then 'WARNING'")} as temp_c_band,
 {_band("current_amps", "when current_amps >= 12 then 'FAULT' when current_amps >= 10 then 'WARNING'")} as current_amps_band,
 {_band("rpm", "when rpm = 0 then 'STOPPED' when rpm > 2800 then 'OVERSPEED'")} as rpm_band,
 {_band("humidity_pct", "when humidity_pct > 70 then 'ELEVATED'")} as humidity_pct_band,
 {_band("throughput_cpm", "when throughput_cpm = 0 then 'STOPPED' when throughput_cpm < 30 then 'DEGRADED'")} as throughput_cpm_band,
 {_clamp("vibration_mm_s / 15")} as vibration_mm_s_gauge, {_clamp("temp_c / 120")} as temp_c_gauge,
 {_clamp("current_amps / 16")} as current_amps_gauge from silver""",
        "vibration_mm_s_gauge temp_c_gauge current_amps_gauge",
    ),
    "freshness_band": _q("""select machine_id,
 case when s is null then 'grey' when s < 120 then 'green' when s < 600 then 'amber' else 'red' end as freshness,
 case when s is null then 'n/a' when s < 60 then format('{}s ago', s)
 when s < 3600 then format('{:.1f}m ago', s / 60.0::double) else format('{:.1f}h ago', s / 3600.0::double) end as age
 from (select machine_id, telemetry_lag_seconds as s from cur)"""),
    "kpi_bands": _q("""select 'fleet' as scope,
 case when avg(oee_pct) >= 80 then 'good' when avg(oee_pct) >= 50 then 'fair' else 'poor' end as first,
 case when avg(prob_fault_next_5m) >= 0.5 then 'high' when avg(prob_fault_next_5m) >= 0.2 then 'elevated' else 'low' end as second
 from cur union all select machine_id,
 case when avg(total_device_to_bronze_ms) < 1000 then 'good' when avg(total_device_to_bronze_ms) < 5000 then 'fair' else 'slow' end, null
 from hops group by machine_id"""),
    "threshold_crossed": _q("""select event_id,
 (temp_c >= 85 or vibration_mm_s >= 9.5 or current_amps >= 12) as threshold_crossed from silver"""),
    "fault_classify": _q(f"""select event_id, cause, case when fault_code = 'BEARING_WEAR' then 'MANUAL_FAULT' else cause end as cause_manual
 from (select *, case when current_amps >= 12 then 'OVERCURRENT' when vibration_mm_s >= 9.5 and rpm > 2000 then 'BEARING_WEAR'
 when temp_c >= 85 then 'OVERTEMP' else 'VIBRATION' end as cause from silver where {_FAULTY})"""),
    "rule_flag": _q(f"select event_id, {_RULE} as rule_flag from silver"),
    "rule_alerts": _q("""select machine_id, event_time, vibration_mm_s, temp_c, rpm, state,
 'streaming_anomaly' as alert_type, (select t from now) as detected_at from silver
 where vibration_mm_s > 8 and temp_c > 85 and state = 'RUN'"""),
    "param_in_filters": _q("""select machine_id, line_name, state, device_ts from hops
 where state in ('RUN', 'FAULT') and line_name in ('Physical Line 0000', 'Virtual Line 0004')"""),
    "machine_id_valid": _q("""select distinct machine_id, regexp_full_match(machine_id, 'MC-[0-9]{4}') as valid
 from bronze"""),
    "localize_ts": _q("select event_id, event_time - interval 5 hour as event_time from silver"),
    "drop_incomplete": _q("""select event_id, machine_id from fx where machine_id is not null and vibration_mm_s is not null
 and temp_c is not null and throughput_cpm is not null and rpm is not null and current_amps is not null
 and humidity_pct is not null"""),
    "valid_mirror_rows": _q("""select machine_id, epoch_ms(device_ms) as last_event_time, event_id from fx
 where machine_id <> '' and device_ms is not null"""),
    "valid_mirror_counts": _q("""select count(*) as row_count, count(*) filter (ok) as valid_rows,
 count(*) filter (not ok) as invalid_rows, max(epoch_ms(device_ms)) filter (ok) as source_watermark
 from (select *, coalesce(machine_id <> '', false) and device_ms is not null as ok from fx)"""),
    "live_lag": _q("select machine_id, telemetry_lag_ms, live_telemetry_lag_ms from cur"),
    "saved_filters": _q(f"""select count(*) filter (prob_fault_next_5m >= 0.5) as high_risk,
 count(*) filter (prob_fault_next_5m >= 0.8) as critical_risk,
 count(*) filter (anomaly_score >= 0.7) as anomaly_detected,
 count(*) filter (state = 'RUN') as running, count(*) filter (state = 'FAULT') as faulted,
 count(*) filter (last_event_time >= {_SINCE.format("1 hour")}) as last_hour,
 count(*) filter (last_event_time >= {_SINCE.format("1 day")}) as last_day from cur"""),
    # ---- joins
    "machine_health": _q("select * from health", _HEALTH_DOUBLES),
    "machine_health_v0": _q(
        """select g.machine_id, window_start, window_end, oee_pct,
 coalesce(a.anomaly_score, g.anomaly_score) as anomaly_score, coalesce(a.is_anomaly, g.is_anomaly) as is_anomaly,
 coalesce(f.prob_fault_next_5m, rule_based_risk_score) as prob_fault_next_5m,
 coalesce(f.predicted_fault_next_5m, rule_based_risk_score >= 0.5) as predicted_fault_next_5m
 from gold g
 left join (select * from anomaly qualify row_number() over (partition by machine_id order by event_time desc, event_id desc) = 1) a
  on a.machine_id = g.machine_id
 left join (select * from fault qualify row_number() over (partition by machine_id order by event_time desc, event_id desc) = 1) f
  on f.machine_id = g.machine_id""",
        "oee_pct anomaly_score prob_fault_next_5m",
    ),
    "current_status": _q("select * from cur", _STATUS_DOUBLES),
    "latency_with_line": _q("select machine_id, line_name, state, total_device_to_bronze_ms from hops"),
    "drilldown": _q(
        f"""select machine_id, line_name, state, last_event_time, telemetry_lag_ms, ml_lag_ms, temp_c, vibration_mm_s,
 rpm, current_amps, humidity_pct, throughput_cpm, load_pct, power_kw, power_factor, voltage_v, pressure_bar,
 flow_rate_lpm, oee_pct, anomaly_score, prob_fault_next_5m, prob_fault_next_1h, prob_fault_next_24h,
 prob_fault_next_7d, {_MAINTENANCE} as maintenance_band from cur""",
        f"{_SENSOR_DOUBLES} oee_pct anomaly_score {_P}",
    ),
    "oee_by_line": _q(
        "select machine_id, line_name, oee_pct, availability_pct, performance_pct, quality_pct from cur", _OEE4
    ),
    "gold_vs_mirror_delta": _q("""select l.machine_id, l.last_event_time as gold_event_time,
 m.last_event_time as mirror_event_time, epoch_ms(m.last_event_time) - epoch_ms(l.last_event_time) as sync_delta_ms
 from latest l join mirror m on m.machine_id = l.machine_id"""),
    "enrich_live": _q(
        f"""select m.machine_id, m.last_event_time, m.state, {", ".join("m." + c.strip() for c in _SENSORS.split(","))},
 m.fault_code, m.iothub_device_id, (select ms from now) - epoch_ms(m.last_event_time) as telemetry_lag_ms,
 c.line_name, c.oee_pct, c.availability_pct, c.performance_pct, c.quality_pct, c.anomaly_score,
 c.prob_fault_next_5m, c.anomaly_inference_type, c.fault_inference_type
 from mirror m left join cur c on c.machine_id = m.machine_id""",
        f"{_SENSOR_DOUBLES} {_OEE4} anomaly_score prob_fault_next_5m",
    ),
    "changed_since_mirror": _q("""select l.machine_id, l.last_event_time, l.state,
 case when m.machine_id is null then 'insert' else 'update' end as change
 from latest l left join mirror m on m.machine_id = l.machine_id
 where m.machine_id is null or m.last_event_time is distinct from l.last_event_time or m.state is distinct from l.state"""),
    # ---- aggregations
    "gold_health_window": _q(
        "select * from win5",
        "avg_vibration_mm_s avg_temp_c avg_throughput_cpm avg_rpm avg_current_amps avg_humidity_pct fault_rate",
    ),
    "gold_health_window_1m": _q(
        f"select * exclude (a, p, q) from ({_oee('(' + _windows('1 minute') + ')', 60, 80)})",
        f"{_OEE_NUMBERS} fault_rate",
    ),
    "gold_oee": _q(f"select {_GOLD_COLUMNS} from gold", _OEE_NUMBERS),
    "gold_oee_from_messages": _q(f"select {_GOLD_COLUMNS} from gold", _OEE_NUMBERS),
    "gold_anomaly_rule": _q(
        "select machine_id, window_start, anomaly_score, is_anomaly from gold", "anomaly_score"
    ),
    "gold_risk_rule": _q(
        "select machine_id, window_start, rule_based_risk_score from gold", "rule_based_risk_score"
    ),
    "status_window_10s": _q("select * from status10", _SENSOR_DOUBLES),
    "mv_machine_telemetry": _q(
        """select machine_id as machine, state, date_trunc('hour', event_time) as event_hour, count(*) as event_count,
 avg(temp_c) as avg_temp_c, avg(vibration_mm_s) as avg_vibration_mm_s, avg(throughput_cpm) as avg_throughput_cpm,
 avg(load_pct) as avg_load_pct, avg(power_kw) as avg_power_kw, avg(pressure_bar) as avg_pressure_bar,
 avg(flow_rate_lpm) as avg_flow_lpm from silver group by all""",
        "avg_temp_c avg_vibration_mm_s avg_throughput_cpm avg_load_pct avg_power_kw avg_pressure_bar avg_flow_lpm",
    ),
    "mv_machine_oee": _q(
        """select machine_id as machine, date_trunc('hour', window_end) as window_hour, avg(oee_pct) as oee_pct,
 avg(availability_pct) as availability_pct, avg(performance_pct) as performance_pct, avg(quality_pct) as quality_pct
 from gold group by all""",
        _OEE4,
    ),
    "mv_machine_downtime": _q(
        """select machine_id as machine, window_end::date as window_date, sum(time_in_run_s) as run_seconds,
 sum(time_in_stopped_s) as stopped_seconds, sum(time_in_fault_s) as fault_seconds,
 sum(time_in_stopped_s + time_in_fault_s) as downtime_seconds,
 sum(time_in_stopped_s + time_in_fault_s) / nullif(sum(time_in_run_s + time_in_stopped_s + time_in_fault_s), 0) * 100 as downtime_pct
 from gold group by all""",
        "run_seconds stopped_seconds fault_seconds downtime_seconds downtime_pct",
    ),
    "mv_machine_risk": _q(
        """select machine_id as machine, window_end::date as window_date, avg(anomaly_score) as avg_anomaly_score,
 avg(prob_fault_next_5m) as avg_fault_risk_5m, avg(prob_fault_next_1h) as avg_fault_risk_1h,
 avg(prob_fault_next_24h) as avg_fault_risk_24h, avg(prob_fault_next_7d) as avg_fault_risk_7d,
 count(*) filter (prob_fault_next_5m >= 0.5) as high_risk_windows, count(*) filter (is_anomaly) as anomaly_windows
 from health group by all""",
        "avg_anomaly_score avg_fault_risk_5m avg_fault_risk_1h avg_fault_risk_24h avg_fault_risk_7d",
    ),
    "mv_machine_freshness": _q(
        """select machine_id as machine, state, avg(telemetry_lag_seconds) as avg_telemetry_lag_seconds,
 avg(ml_lag_seconds) as avg_ml_lag_seconds, avg(telemetry_lag_ms) as avg_telemetry_lag_ms, avg(ml_lag_ms) as avg_ml_lag_ms,
 max(telemetry_lag_seconds) as max_telemetry_lag_seconds, max(ml_lag_seconds) as max_ml_lag_seconds,
 max(telemetry_lag_ms) as max_telemetry_lag_ms, max(ml_lag_ms) as max_ml_lag_ms from cur group by all""",
        "avg_telemetry_lag_seconds avg_ml_lag_seconds avg_telemetry_lag_ms avg_ml_lag_ms",
    ),
    "mv_machine_current": _q(
        """select state, avg(temp_c) as current_temp_c, avg(vibration_mm_s) as current_vibration_mm_s,
 avg(throughput_cpm) as current_throughput_cpm, avg(load_pct) as current_load_pct, avg(oee_pct) as current_oee_pct,
 avg(prob_fault_next_5m) as current_fault_risk_5m, avg(prob_fault_next_1h) as current_fault_risk_1h,
 avg(prob_fault_next_24h) as current_fault_risk_24h, avg(prob_fault_next_7d) as current_fault_risk_7d,
 avg(anomaly_score) as current_anomaly_score, avg(power_kw) as current_power_kw,
 avg(pressure_bar) as current_pressure_bar, avg(flow_rate_lpm) as current_flow_lpm from cur group by state""",
        "current_temp_c current_vibration_mm_s current_throughput_cpm current_load_pct current_oee_pct "
        "current_fault_risk_5m current_fault_risk_1h current_fault_risk_24h current_fault_risk_7d "
        "current_anomaly_score current_power_kw current_pressure_bar current_flow_lpm",
    ),
    "mv_hop_latency": _q(
        f"""select line_name as line, state, date_trunc('hour', device_ts) as device_hour,
 count(*) as record_count, {_MV_HOPS} from hops group by all""",
        _MV_HOPS_DOUBLES,
    ),
    "mv_hop_latency_total": _q(
        f"select count(*) as record_count, {_MV_HOPS} from hops", _MV_HOPS_DOUBLES
    ),
    "measure_query_freshness": _q(
        """select machine_id as machine, avg(telemetry_lag_ms) as avg_telemetry_lag_ms, avg(ml_lag_ms) as avg_ml_lag_ms,
 max(telemetry_lag_ms) as max_telemetry_lag_ms, max(ml_lag_ms) as max_ml_lag_ms from cur group by all""",
        "avg_telemetry_lag_ms avg_ml_lag_ms",
    ),
    "measure_query_oee_hour": _q(
        """select date_trunc('hour', window_end) as window_hour, avg(oee_pct) as oee_pct,
 avg(availability_pct) as availability_pct, avg(performance_pct) as performance_pct, avg(quality_pct) as quality_pct
 from gold group by all""",
        _OEE4,
    ),
    "measure_query_risk_day": _q(
        """select window_end::date as window_date, avg(prob_fault_next_5m) as avg_fault_risk_5m,
 avg(prob_fault_next_1h) as avg_fault_risk_1h, avg(prob_fault_next_24h) as avg_fault_risk_24h,
 avg(prob_fault_next_7d) as avg_fault_risk_7d, count(*) filter (prob_fault_next_5m >= 0.5) as high_risk_windows
 from health group by all""",
        "avg_fault_risk_5m avg_fault_risk_1h avg_fault_risk_24h avg_fault_risk_7d",
    ),
    "fleet_kpis": _q(
        """select avg(oee_pct) as fleet_oee_pct, avg(anomaly_score) as avg_anomaly_score,
 avg(prob_fault_next_5m) as avg_fault_risk_5m, avg(prob_fault_next_24h) as avg_fault_risk_24h,
 avg(prob_fault_next_7d) as avg_fault_risk_7d, count(*) filter (prob_fault_next_5m >= 0.5) as watch_machines_5m,
 count(*) filter (prob_fault_next_24h >= 0.5) as watch_machines_24h,
 count(*) filter (prob_fault_next_7d >= 0.5) as watch_machines_7d,
 avg(telemetry_lag_ms) as avg_telemetry_lag_ms, avg(ml_lag_ms) as avg_ml_lag_ms from cur""",
        "fleet_oee_pct avg_anomaly_score avg_fault_risk_5m avg_fault_risk_24h avg_fault_risk_7d "
        "avg_telemetry_lag_ms avg_ml_lag_ms",
    ),
    "fleet_summary": _q("""select count(*) as total_machines, count(*) filter (state = 'RUN') as running,
 count(*) filter (state = 'STOPPED') as stopped, count(*) filter (state = 'FAULT') as faulted,
 round(avg(oee_pct), 1) as avg_oee_pct, round(avg(prob_fault_next_5m), 3) as avg_fault_risk,
 count(*) filter (prob_fault_next_5m >= 0.8) as critical_machines,
 count(*) filter (anomaly_score >= 0.7) as anomaly_machines from cur"""),
    "downtime_by_line": _q(f"""select line_name, count(distinct h.machine_id) as machines,
 round(sum(time_in_fault_s), 0) as fault_downtime_s, round(sum(time_in_stopped_s), 0) as planned_stop_s,
 round(sum(time_in_stopped_s + time_in_fault_s), 0) as total_downtime_s, round(avg(oee_pct), 1) as avg_oee_pct
 from health h left join dim d on d.machine_id = h.machine_id
 where window_end >= {_SINCE.format("1 day")} group by line_name"""),
    "downtime_by_machine": _q(
        f"""select machine_id, sum(time_in_stopped_s + time_in_fault_s) as downtime_s from health
 where window_end >= {_SINCE.format("1 hour")} group by machine_id""",
        "downtime_s",
    ),
    "latency_by_machine": _q(f"""select machine_id, round(avg(device_to_hub_ms), 0) as avg_device_to_hub_ms,
 round(avg(hub_to_bridge_ms), 0) as avg_hub_to_bridge_ms,
 round(avg(device_to_hub_ms + hub_to_bridge_ms), 0) as avg_total_latency_ms,
 max(device_to_hub_ms) as max_device_to_hub_ms, max(hub_to_bridge_ms) as max_hub_to_bridge_ms,
 count(*) as event_count from silver where event_time >= {_SINCE.format("1 hour")}
 group by machine_id order by avg_total_latency_ms desc, machine_id limit 20"""),
    "latency_stats": _q(
        _latency_stats(f"device_ts >= {_SINCE.format('30 minute')} and state in ('RUN', 'FAULT')")
    ),
    "fleet_latency_rollup": _q(
        f"""select avg(avg_d2h_ms) as mean_of_avg_d2h_ms, avg(avg_h2b_ms) as mean_of_avg_h2b_ms,
 avg(avg_total_ms) as mean_of_avg_total_ms, avg(p50_total_ms) as mean_of_p50_total_ms,
 avg(p95_total_ms) as mean_of_p95_total_ms, sum(sample_count)::bigint as samples
 from ({_latency_stats(f"device_ts >= {_SINCE.format('60 minute')}")})""",
        "mean_of_avg_d2h_ms mean_of_avg_h2b_ms mean_of_avg_total_ms mean_of_p50_total_ms mean_of_p95_total_ms",
    ),
    "hop_breakdown": _q(
        f"select count(*) as sample_count, {_BREAKDOWN} from hops where device_ts > {_SINCE.format('20 minute')}"
    ),
    "gold_lag_summary": _q("""select count(*) as machine_count, round(quantile_cont(telemetry_lag_ms, 0.5), 0) as p50_lag_ms,
 round(quantile_cont(telemetry_lag_ms, 0.95), 0) as p95_lag_ms, min(telemetry_lag_ms) as min_lag_ms,
 max(telemetry_lag_ms) as max_lag_ms, round(avg(telemetry_lag_ms), 0) as avg_lag_ms from latest"""),
    "bronze_recent": _q(f"""select count(*) as recent_records, min(epoch_ms(ingest_ms)) as earliest,
 max(epoch_ms(ingest_ms)) as latest from bronze where epoch_ms(ingest_ms) > {_SINCE.format("20 minute")}"""),
    "freshness_summary": _q(
        """select max(last_event_time) as latest_event, max(telemetry_lag_ms) as max_lag_ms,
 avg(telemetry_lag_ms) as avg_lag_ms, count(distinct machine_id) as machine_count, count(*) as row_count,
 greatest(0, ((select ms from now) - epoch_ms(max(last_event_time))) / 1000::double) as age_seconds from cur""",
        "avg_lag_ms age_seconds",
    ),
    "risk_mix": _q(f"""select {_RISK.format("prob_fault_next_5m")} as risk_band, count(*) as machine_count from cur
 where last_event_time >= {_SINCE.format("10 minute")} group by 1"""),
    "fault_mix": _q(f"""select coalesce(fault_code, 'NONE') as fault_code, count(*) as records from silver
 where event_time >= {_SINCE.format("10 minute")} group by 1 order by records desc, 1 limit 10"""),
    "risk_cards": _q(
        """select count(*) filter (coalesce(prob_fault_next_5m, 0) >= 0.8) as critical_machines,
 count(*) filter (coalesce(prob_fault_next_5m, 0) >= 0.5 and coalesce(prob_fault_next_5m, 0) < 0.8) as watch_machines,
 count(*) filter (coalesce(prob_fault_next_5m, 0) < 0.5) as normal_machines,
 avg(coalesce(prob_fault_next_5m, 0)) as avg_risk from cur""",
        "avg_risk",
    ),
    "explorer_kpis": _q(
        """select count(*) filter (state in ('RUN', 'FAULT')) as shown, count(*) as total,
 count(*) filter (state = 'RUN') as running, 0::bigint as stopped, count(*) filter (state = 'FAULT') as faulted,
 avg(oee_pct) filter (state in ('RUN', 'FAULT')) as avg_oee_pct,
 avg(prob_fault_next_5m) filter (state in ('RUN', 'FAULT')) as avg_risk from cur""",
        "avg_oee_pct avg_risk",
    ),
    "status_summary": _q(
        """select count(*) as row_count, count(distinct machine_id) as machine_count,
 avg(prob_fault_next_5m) as avg_risk, max(last_event_time) as latest_event from cur""",
        "avg_risk",
    ),
    "sr_status_counts": _q("""select s.status, count(r.id) as requests
 from (values ('OPEN'), ('IN_PROGRESS'), ('RESOLVED'), ('CANCELLED')) s(status)
 left join requests r on r.status = s.status group by s.status"""),
    "saved_measures": _q(
        """select sum(time_in_stopped_s + time_in_fault_s) as total_downtime_s, round(avg(oee_pct), 1) as avg_oee,
 round(avg(prob_fault_next_5m), 3) as fleet_risk, count(distinct machine_id) as machine_count from health""",
        "total_downtime_s",
    ),
    "machine_summary_lines": _q(_SUMMARY),
    "score_stats": _q(
        f"""select inference_type, count(*) as rows_scored, count(distinct machine_id) as machines_scored,
 avg(s) as mean_score, avg(case when s >= 0.7 then 1::double else 0::double end) as anomaly_rate
 from (select *, {_clamp(f"{_MODEL} * 0.7::double + {_RULE} * 0.3::double")} as s from ({_both_modes(2)}))
 group by inference_type""",
        "mean_score anomaly_rate",
    ),
    "prediction_stats": _q(
        """select inference_type, count(*) as rows_scored, count(distinct machine_id) as machines_scored,
 avg(prob_fault_next_5m) as mean_risk_5m, avg(prob_fault_next_24h) as mean_risk_24h,
 avg(prob_fault_next_7d) as mean_risk_7d,
 avg(case when predicted_fault_next_5m then 1::double else 0::double end) as high_risk_rate
 from fault group by inference_type""",
        "mean_risk_5m mean_risk_24h mean_risk_7d high_risk_rate",
    ),
    "probe_stats": _q(
        """select machine_id, count(*) as samples, min(lag) as min_ms, avg(lag) as mean_ms, max(lag) as max_ms,
 stddev_samp(lag) as stdev_ms, list_sort(list(lag))[(count(*) * 0.5::double)::int64 + 1 - (case when (count(*) * 0.5::double)::int64 > count(*) * 0.5::double then 1 else 0 end)] as p50_ms,
 list_sort(list(lag))[least(floor(count(*) * 0.95::double)::int64, count(*) - 1) + 1] as p95_ms
 from (select machine_id, epoch_ms(ingest_ts) - epoch_ms(event_time) as lag from silver) group by machine_id""",
        "mean_ms stdev_ms",
    ),
    # ---- window functions
    "latest_by_key": _q(
        f"""select {_SILVER_COLUMNS} from silver
 qualify row_number() over (partition by machine_id order by event_time desc, event_id desc) = 1""",
        _SENSOR_DOUBLES,
    ),
    "latest_scores": _q(
        """select * from anomaly
 qualify row_number() over (partition by machine_id order by event_time desc, event_id desc) = 1""",
        "anomaly_score",
    ),
    "label_future_fault": _q(_future(300, "label_fault_next_5m")),
    "label_future_fault_20s": _q(_future(20, "label_20s")),
    "label_next_rows": _q(f"""select event_id, case when max(case when {_FAULTY} then 1 else 0 end) over (
 partition by machine_id order by event_time, event_id rows between 1 following and 3 following) = 1
 then 1 else 0 end as label_fault_next_5m from silver"""),
    "change_points": _q(
        """select machine_id, poll_time, seen_time, round((epoch_us(poll_time) - epoch_us(seen_time)) / 1000.0::double, 1) as lag_ms
 from (select *, lag(seen_time) over (partition by machine_id order by poll_time) as previous
  from (select machine_id, poll_time + to_microseconds(extra) as poll_time, seen_time
   from (select machine_id, time_bucket(interval 10 second, event_time) + interval 10 second as poll_time,
     max(event_time) as seen_time from silver group by 1, 2), (values (0), (1)) v(extra)))
 where previous is not null and previous <> seen_time"""
    ),
    # ---- sorts, limits, top-k
    "metric_summary": _q(
        f"""select machine_id, state, oee_pct, anomaly_score, prob_fault_next_5m, telemetry_lag_ms, ml_lag_ms,
 last_event_time from cur {_TOP.format("prob_fault_next_5m desc, anomaly_score desc, machine_id", 200)}""",
        "oee_pct anomaly_score prob_fault_next_5m",
    ),
    "flow_break_signals": _q(
        f"""select machine_id, state, throughput_cpm, vibration_mm_s, temp_c, current_amps, humidity_pct, load_pct,
 anomaly_score, prob_fault_next_5m, telemetry_lag_ms, last_event_time from cur
 {_TOP.format("prob_fault_next_5m desc, telemetry_lag_ms desc, machine_id", 200)}""",
        "load_pct anomaly_score prob_fault_next_5m",
    ),
    "top_risk_25": _q(
        f"""select machine_id, state, prob_fault_next_5m from cur
 {_TOP.format("prob_fault_next_5m desc, machine_id", 25)}""",
        "prob_fault_next_5m",
    ),
    "risk_ranking": _q(
        """select machine_id, state, oee_pct, anomaly_score, prob_fault_next_5m, prob_fault_next_1h,
 prob_fault_next_24h, prob_fault_next_7d, last_event_time from cur""",
        f"oee_pct anomaly_score {_P}",
    ),
    **{
        name: _q(f"""select machine_id, line_name, round(prob_fault_next_5m, 3) as fault_risk_5m,
 round(prob_fault_next_1h, 3) as fault_risk_1h, round(anomaly_score, 3) as anomaly_score, state, fault_code,
 telemetry_lag_ms as lag_ms from cur {_TOP.format("cur.prob_fault_next_5m desc, machine_id", n)}""")
        for name, n in (("top_fault_risk", 10), ("top_fault_risk_5", 5))
    },
    "lag_ranking": _q(
        f"""select machine_id, state, last_event_time, telemetry_lag_ms, ml_lag_ms, prob_fault_next_5m, anomaly_score
 from cur {_TOP.format("telemetry_lag_ms desc, ml_lag_ms desc, machine_id", 20)}""",
        "prob_fault_next_5m anomaly_score",
    ),
    "recent_status": _q(
        f"select machine_id, state, last_event_time from mirror {_TOP.format('last_event_time desc, machine_id', 200)}"
    ),
    "fleet_freshness_recent": _q(
        f"""select machine_id, state, telemetry_lag_ms, ml_lag_ms, prob_fault_next_5m, last_event_time from cur
 where last_event_time >= {_SINCE.format("5 minute")}
 {_TOP.format("telemetry_lag_ms, last_event_time desc, machine_id", 50)}""",
        "prob_fault_next_5m",
    ),
    "oee_ascending": _q("""select machine_id, line_name, round(oee_pct, 1) as oee_pct,
 round(availability_pct, 1) as availability_pct, round(performance_pct, 1) as performance_pct,
 round(quality_pct, 1) as quality_pct, state from cur"""),
    "oee_by_window": _q(
        f"""select machine_id, window_end, date_trunc('hour', window_end) as window_hour, oee_pct, availability_pct,
 performance_pct, quality_pct, time_in_run_s, time_in_stopped_s, time_in_fault_s from health
 where window_end between {_SINCE.format("2 hour")} and (select t from now)""",
        f"{_OEE4} time_in_run_s time_in_stopped_s time_in_fault_s",
    ),
    "sr_list": _q(f"""select * from requests where status in ('OPEN', 'IN_PROGRESS') and priority in ('CRITICAL', 'HIGH')
 {_TOP.format("created_at desc, id", 5000)}"""),
    "sr_total": _q("""select count(*) as total_count from requests
 where status in ('OPEN', 'IN_PROGRESS') and priority in ('CRITICAL', 'HIGH')"""),
    "sr_sort_priority": _q("""select id, priority, status from requests order by case priority when 'CRITICAL' then 0
 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end, id"""),
    "machine_point_lookup": _q("""select machine_id, round(prob_fault_next_5m, 3) as risk_5m, round(prob_fault_next_1h, 3) as risk_1h,
 round(prob_fault_next_24h, 3) as risk_24h, round(prob_fault_next_7d, 3) as risk_7d,
 round(anomaly_score, 3) as anomaly, state, fault_code from cur where machine_id = 'MC-0000'"""),
    "machine_trend": _q(f"""select event_time, machine_id, round(vibration_mm_s, 2) as vibration, round(temp_c, 2) as temp,
 round(current_amps, 2) as amps, rpm, state from silver
 where machine_id = 'MC-0000' and event_time >= {_SINCE.format("1 hour")}"""),
    **{
        name: _q(f"""select machine_id, line_name, round(anomaly_score, 3) as anomaly_score,
 round(prob_fault_next_5m, 3) as fault_risk_5m, round(vibration_mm_s, 2) as vibration, round(temp_c, 1) as temp_c,
 state, fault_code from cur where cur.{test}""")
        for name, test in (
            ("over_threshold_anomaly", "anomaly_score >= 0.7"),
            ("over_threshold_vibration", "vibration_mm_s >= 8"),
        )
    },
    "fleet_answers": _q("""select count(*) filter (state = 'RUN') as running_machines, round(avg(oee_pct), 1) as avg_oee_pct,
 round(avg(telemetry_lag_ms), 0) as avg_lag_ms, max(telemetry_lag_ms) as max_lag_ms from cur"""),
    "latest_oee": _q(
        "select machine_id, oee_pct, availability_pct, performance_pct, quality_pct from cur", _OEE4
    ),
    "fleet_status": _q(f"""select machine_id, line_name, state, rpm, round(temp_c, 1) as temp_c,
 round(vibration_mm_s, 2) as vibration, round(current_amps, 1) as amps, round(oee_pct, 1) as oee_pct,
 round(prob_fault_next_5m, 2) as risk_5m, {_RISK.format("prob_fault_next_5m")} as risk_band from cur"""),
    # ---- set operations and scoring
    "score_modes_union": _q(f"""select event_id, machine_id, event_time, inference_type, {_RULE} as rule_flag
 from ({_both_modes(2)})"""),
    "blend_score": _q(
        "select event_id, rule_flag, anomaly_score, anomaly_score >= 0.7 as is_anomaly from scorable",
        "anomaly_score",
    ),
    "horizon_expand": _q(
        """select event_id, p as p_5m, 1 - pow(1 - p, 12) as p_1h, 1 - pow(1 - p, 288) as p_24h,
 1 - pow(1 - p, 2016) as p_7d from (select event_id, humidity_pct / 7100 as p from silver)""",
        "p_5m p_1h p_24h p_7d",
    ),
    "fault_predictions": _q("select * from fault", _P),
    "score_windows": _q(f"""select inference_type, machine_id, count(*) as events from ({_both_modes(1)})
 group by all"""),
    "training_export": _q(_EXPORT, _SENSOR_DOUBLES),
    "last_scored_ts": _q("select max(scored_at) as last_scored_at from anomaly"),
    # ---- sinks, mirror, checks
    "upsert_parquet": _q("select machine_id, last_event_time, state, temp_c, rpm from latest"),
    "sink_append": _q("""select machine_id, event_time, vibration_mm_s, temp_c, rpm, state,
 'streaming_anomaly' as alert_type, (select t from now) as detected_at from silver
 where vibration_mm_s > 8 and temp_c > 85 and state = 'RUN'"""),
    "sr_bulk_load": _q("""select status, priority, request_type, count(*) as requests from requests group by all"""),
    "validate_outputs": _q(
        " union all ".join(
            f"select '{t}' as table_name, count(*) as row_count from {t}"
            for t in ("bronze", "silver", "gold", "anomaly", "fault")
        )
    ),
    "dry_run_validate": _q("""select count(*) as row_count, count(*) as valid_rows, 0::bigint as invalid_rows,
 max(last_event_time) as source_watermark, false as written from cur"""),
    "score_publish": _q(
        """select *, count(*) over (partition by machine_id) as history_rows from anomaly
 qualify row_number() over (partition by machine_id order by event_time desc, event_id desc) = 1""",
        "anomaly_score",
    ),
    "parity_check": _q("""select (select count(*) from latest) as left_rows, (select count(*) from mirror) as right_rows,
 (select max(last_event_time) from latest) as left_latest, (select max(last_event_time) from mirror) as right_latest,
 (select count(*) from latest where machine_id not in (select machine_id from mirror)) as missing_right,
 (select count(*) from mirror where machine_id not in (select machine_id from latest)) as missing_left,
 (select count(*) from latest) = (select count(*) from mirror) as counts_equal"""),
    "view_refresh_counts": _q(f"""select 'live_rows' as table_name, count(*) as row_count from silver
 where event_time >= {_SINCE.format("24 hour")}
 union all select 'health_rows', count(*) from health union all select 'status_rows', count(*) from cur
 union all select 'downtime_rows', count(*) from health"""),
    "stream_health": _q(
        f"select count(*) as records from silver where event_time >= {_SINCE.format('60 minute')}"
    ),
    "view_register": _q(
        "select machine_id, state, line_name, oee_pct, anomaly_score, prob_fault_next_24h from cur",
        "oee_pct anomaly_score prob_fault_next_24h",
    ),
    "sr_update_status": _q("""select status, priority, count(*) as requests, max(updated_at) as last_change from (
 select priority, case when priority = 'CRITICAL' and status = 'OPEN' then 'IN_PROGRESS' else status end as status,
 case when priority = 'CRITICAL' and status = 'OPEN' then (select t from now) else updated_at end as updated_at
 from requests) group by 1, 2"""),
    "sr_create": _q("""select 'b1-' || regexp_extract(machine_id, '([0-9]+)$', 1) as id, machine_id, 'HIGH' as priority,
 'INSPECTION' as request_type, 'check' as description, 'planner' as requestor, 'OPEN' as status,
 (select t from now) as created_at, (select t from now) as updated_at from cur"""),
    "stored_silver_lookback": _q(
        f"select {_SILVER_COLUMNS} from silver where event_time >= {_SINCE.format('60 minute')}", _SENSOR_DOUBLES
    ),
    # ---- models: what must hold whatever was learned
    "fault_score_checks": _q(f"""select inference_type, count(*) as rows_scored, 0::bigint as outside,
 0::bigint as shrinking, 0::bigint as flags_unlike from ({_both_modes(24)}) group by 1"""),
    "anomaly_score_checks": _q(f"""select inference_type, count(*) as rows_scored, 0::bigint as outside,
 0::bigint as flags_unlike from ({_both_modes(24)}) where {_COMPLETE} group by 1"""),
    "fault_metrics_checks": _q(f"select count(*) as train_rows, true as plausible from silver where {_COMPLETE}"),
    "fault_train_guard": _q("select count(*) as rows, true as reused_last_model from silver"),
    "model_registry_lookup": _q(f"select true as newest_found, count(*) as rows_scored from silver where {_COMPLETE}"),
    "scored_health": _q("""select machine_id, count(*) as windows, count(*) as with_risk, any_value(n) as scored_rows
 from health join (select machine_id, count(*) as n from silver group by 1) using (machine_id) group by 1"""),
    # ---- streams
    "src_stream_table": _q("select event_id, machine_id, state, enqueued_ms from fx"),
    "stream_bridge": _q(f"select {_BRONZE_OUT} from bronze", _SENSOR_DOUBLES),
    "stream_silver": _q(f"select {_SILVER_COLUMNS} from silver", _SENSOR_DOUBLES),
    "stream_gold_health": _q(
        f"""select {_GOLD_COLUMNS}, anomaly_score, is_anomaly, rule_based_risk_score from gold
 where window_end <= {_SINCE.format("2 minute")}""",
        f"{_OEE_NUMBERS} anomaly_score rule_based_risk_score",
    ),
    "stream_late_data": _q(
        f"""select {_GOLD_COLUMNS}, anomaly_score, is_anomaly, rule_based_risk_score from gold
 where window_end <= {_SINCE.format("2 minute")}""",
        f"{_OEE_NUMBERS} anomaly_score rule_based_risk_score",
    ),
    "stream_status_10s": _q(
        f"""select machine_id, last_event_time, {_STATUS_COLUMNS}, iothub_device_id, event_id,
 telemetry_lag_seconds, telemetry_lag_ms from status10
 where time_bucket(interval 10 second, last_event_time) + interval 10 second <= {_SINCE.format("10 second")}""",
        _SENSOR_DOUBLES,
    ),
    "stream_latest_scd1": _q("""select machine_id, event_time as last_event_time, state, temp_c, rpm, event_id,
 ((select ms from now) // 1000 - epoch_ms(event_time) // 1000)::int as telemetry_lag_seconds,
 ((select ms from now) // 1000 - epoch_ms(event_time) // 1000) * 1000 as telemetry_lag_ms from silver
 qualify row_number() over (partition by machine_id order by event_time desc, event_id desc) = 1"""),
    "stream_alerts": _q("""select machine_id, event_time, vibration_mm_s, temp_c, rpm, state,
 'streaming_anomaly' as alert_type, (select t from now) as detected_at from silver
 where vibration_mm_s > 8 and temp_c > 85 and state = 'RUN'"""),
}


_CLOSED = f"time_bucket(interval 5 minute, event_time) + interval 5 minute <= {_SINCE.format('2 minute')}"
_TELEMETRY_AVERAGES = """count(*) as event_count, avg(temp_c) as avg_temp_c, avg(vibration_mm_s) as avg_vibration_mm_s,
 avg(throughput_cpm) as avg_throughput_cpm, avg(load_pct) as avg_load_pct, avg(power_kw) as avg_power_kw,
 avg(pressure_bar) as avg_pressure_bar, avg(flow_rate_lpm) as avg_flow_lpm"""
_TELEMETRY_DOUBLES = (
    "avg_temp_c avg_vibration_mm_s avg_throughput_cpm avg_load_pct avg_power_kw avg_pressure_bar avg_flow_lpm"
)
_HOPS3 = {
    "device_to_hub_ms": "hop1_device_to_hub_ms",
    "hub_to_bronze_ms": "hop2_hub_to_bronze_ms",
    "total_ms": "total_device_to_bronze_ms",
}
_PARTIALS = {
    "partials_telemetry": _ORACLES["mv_machine_telemetry"],
    "partials_telemetry_stream": _q(
        f"""select state, date_trunc('hour', event_time) as event_hour, {_TELEMETRY_AVERAGES}
 from silver where {_CLOSED} group by all""",
        _TELEMETRY_DOUBLES,
    ),
    "partials_risk": _ORACLES["mv_machine_risk"],
    "partials_hop_latency": _q(
        "select line_name as line, state, date_trunc('hour', device_ts) as device_hour, count(*) as record_count, "
        + ", ".join(f"{how}({c}) as {how}_{n}" for how in ("avg", "min", "max") for n, c in _HOPS3.items())
        + " from hops group by all",
        " ".join(f"avg_{n}" for n in _HOPS3),
    ),
    "partials_sketch_checks": _q("select count(*) as record_count, 0::bigint as outside from hops"),
    "stored_machine_lookup": _q(
        f"select {_SILVER_COLUMNS} from silver where machine_id = 'MC-0003' and event_time >= {_SINCE.format('2 hour')}",
        _SENSOR_DOUBLES,
    ),
    "parity_differences": _q("""select * from (
 select coalesce(l.machine_id, r.machine_id) as machine_id, count(l.machine_id) as left_rows, count(r.machine_id) as right_rows,
  case when count(r.machine_id) = 0 then 'missing_right' when count(l.machine_id) = 0 then 'missing_left'
   when bool_or(l.last_event_time is distinct from r.last_event_time or l.state is distinct from r.state
    or l.temp_c is distinct from r.temp_c or l.rpm is distinct from r.rpm or l.fault_code is distinct from r.fault_code)
   then 'unequal' end as difference
 from latest l full join (select * from mirror where machine_id <> 'MC-0005') r on l.machine_id = r.machine_id
 group by 1) where difference is not null"""),
    "anomaly_cut_checks": _q(f"select count(*) as train_rows, true as exact_share from silver where {_COMPLETE}"),
    "stream_change_feed": _q("""select machine_id, event_time as last_event_time, state, temp_c, rpm, event_id,
 case when first_even and event_id % 2 = 1 then 2 else 1 end::bigint as version, 1::bigint as inserts
 from (select *, bool_or(event_id % 2 = 0) over (partition by machine_id) as first_even from silver)
 qualify row_number() over (partition by machine_id order by event_time desc, event_id desc) = 1"""),
    "sink_retry_batch": _ORACLES["stream_alerts"],
    "score_incremental": _q(f"""with rows as (select * from silver where {_COMPLETE}),
 scored as (
  select 'batch' as mode, event_id, event_time from rows where event_time >= (select t - interval 3 hour from now)
  union all
  select 'realtime', event_id, event_time from rows where event_time >= (select t - interval 70 minute from now))
 select mode as inference_type, count(*) as rows_scored, count(distinct event_id) as events_scored, max(event_time) as mark
 from scored group by 1""").replace("with rows as", ", rows as", 1),
    "stream_late_rows": _q(f"""select machine_id, count(*) as on_time, count(*) filter (old) as late,
 count(*) + count(*) filter (old) as event_count
 from (select machine_id, event_time <= (select t - interval 2 hour from now) as old from silver) group by 1"""),
}


def oracles() -> dict[str, str]:
    return _ORACLES | _PARTIALS
