"""Silver rules, quality, windows, OEE: edge values by hand."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.expr import before, clamp, instant, rows_since
from fleetlens.operators import gold, quality
from fleetlens.operators.silver import silver_clean
from fleetlens.schemas import BRONZE, SILVER
from tests.conftest import as_set, at


def bronze(spark, *rows):
    """Bronze rows from partial dicts."""
    full = [tuple(r.get(n) for n in BRONZE.names) for r in rows]
    return spark.createDataFrame(full, BRONZE)


T0, T1, T2 = "2024-01-01T00:00:00.900Z", "2024-01-01T00:00:02.100Z", "2024-01-01T00:00:05.000Z"


def event(**kwargs):
    base = {"machine_id": "MC-0001", "ts": T0, "iothub_enqueued_time": T1, "ingest_ts": T2, "state": "RUN"}
    return base | kwargs


def test_silver_defaults_and_estimates(spark):
    row = silver_clean(bronze(spark, event(throughput_cpm=60))).first()
    assert (row["rpm"], row["current_amps"], row["humidity_pct"]) == (0, 0.0, 40.0)
    assert (row["power_factor"], row["voltage_v"], row["pressure_bar"], row["flow_rate_lpm"]) == (0.92, 230.0, 2.5, 40.0)
    assert row["load_pct"] == pytest.approx(50.0)
    assert row["power_kw"] is None  # unknown current, not 0
    assert row["iothub_device_id"] == "MC-0001"
    # Whole seconds first: 2 - 0 and 5 - 2.
    assert (row["device_to_hub_ms"], row["hub_to_bridge_ms"]) == (2000, 3000)


def test_silver_schema_and_null_throughput(spark):
    out = silver_clean(bronze(spark, event(current_amps=10.0)))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in SILVER]
    row = out.first()
    assert row["load_pct"] is None  # a clamp of NULL is NULL, not the upper limit
    assert row["power_kw"] == pytest.approx(3.65)


def test_silver_unreadable_times(spark):
    rows = [
        event(ts="yesterday"),
        event(machine_id="MC-0002", ts=None),
        event(machine_id="MC-0003", ts="bad", iothub_enqueued_time="bad"),
        event(machine_id=None),
        event(machine_id="MC-0005", ingest_ts="never"),
    ]
    out = {r["machine_id"]: r for r in silver_clean(bronze(spark, *rows)).collect()}
    assert set(out) == {"MC-0001", "MC-0002", "MC-0005"}
    assert out["MC-0001"]["event_time"] == out["MC-0001"]["enqueued_time"]
    assert out["MC-0005"]["hub_to_bridge_ms"] is None


def test_clamp_null(spark):
    row = spark.range(1).select(
        clamp(F.lit(None).cast("double"), 0, 1).alias("n"),
        clamp(F.lit(2.0), 0, 1).alias("hi"),
        clamp(F.lit(-2.0), 0, 1).alias("lo"),
    )
    assert tuple(row.first()) == (None, 1.0, 0.0)


NUMERIC = [r for r in quality.RULES if r.low is not None]


@pytest.mark.parametrize("rule", NUMERIC, ids=lambda r: r.name)
def test_rule_bounds(spark, rule):
    kind = SILVER[rule.column].dataType.simpleString()
    values = {rule.low - 1: True, rule.low: False, None: True}
    if rule.high is not None:
        values |= {rule.high: False, rule.high + 1: True}
    cast = int if kind == "int" else float
    rows = [(None if v is None else cast(v),) for v in values]
    df = spark.createDataFrame(rows, f"{rule.column} {kind}")
    assert [r[0] for r in df.select(rule.violated()).collect()] == list(values.values())


def test_state_rule_and_flags(frames):
    flagged = quality.flag_rows(frames.silver)
    unknown = flagged.where("array_contains(violated_rules, 'valid_state')")
    assert as_set(unknown, "state") == {("UNKNOWN",)}
    totals = {r["rule"]: r["violations"] for r in quality.count_violations(frames.silver).collect()}
    per_row = flagged.select(F.explode("violated_rules").alias("r")).groupBy("r").count()
    assert {r["r"]: r["count"] for r in per_row.collect()} == {k: v for k, v in totals.items() if v}
    assert len(totals) == 13


def silver_rows(spark, rows):
    """rows: (machine, seconds, state, throughput, fault)"""
    made = [
        event(machine_id=m, ts=f"2024-01-01T00:{int(s) // 60:02d}:{s % 60:06.3f}Z", state=state,
              throughput_cpm=pace, fault_code=code, vibration_mm_s=6.0, temp_c=55.0, rpm=1000,
              current_amps=5.0)
        for m, s, state, pace, code in rows
    ]
    return silver_clean(bronze(spark, *made))


def test_window_of_unknown_states_only(spark):
    silver = silver_rows(spark, [("MC-0001", 1.0, "UNKNOWN", 50, None), ("MC-0001", 2.0, "BROKEN", 50, None)])
    row = gold.machine_health_windows(silver).first()
    assert (row["availability_pct"], row["oee_pct"], row["event_count"]) == (0.0, 0.0, 2)
    assert row["time_in_run_s"] == row["time_in_fault_s"] == 0.0


def test_window_with_zero_throughput_and_fault_code(spark):
    silver = silver_rows(spark, [("MC-0001", 1.0, "RUN", 0, "OVERTEMP"), ("MC-0001", 2.0, "RUN", 0, None)])
    row = gold.machine_health_windows(silver).first()
    assert (row["performance_pct"], row["quality_pct"], row["oee_pct"]) == (0.0, 50.0, 0.0)
    assert row["availability_pct"] == 100.0


def test_window_without_throughput_is_unknown(spark):
    row = gold.machine_health_windows(silver_rows(spark, [("MC-0001", 1.0, "RUN", None, None)])).first()
    assert row["performance_pct"] is None and row["oee_pct"] is None and row["anomaly_score"] is None


def test_oee_properties(frames):
    g = frames.gold
    bad = g.where(
        "oee_pct > least(availability_pct, performance_pct, quality_pct) + 1e-9 or oee_pct < -1e-9 "
        "and performance_pct >= 0 or time_in_run_s + time_in_stopped_s + time_in_fault_s > 300 + 1e-9 "
        "or anomaly_score not between 0 and 1 or rule_based_risk_score not between 0 and 1 "
        "or availability_pct not between 0 and 100"
    )
    assert bad.count() == 0
    assert g.agg(F.sum("event_count")).first()[0] == frames.silver.count()


def test_status_window_breaks_ties(spark):
    silver = silver_rows(
        spark,
        [("MC-0001", 1.0, "RUN", 10, None), ("MC-0001", 1.0, "STOPPED", 20, None), ("MC-0001", 11.0, "RUN", 5, None)],
    )
    first = gold.status_windows(silver)
    assert first.count() == 2
    assert as_set(first) == as_set(gold.status_windows(silver.repartition(5)))


def test_rows_since_prunes_dates(spark, tmp_path):
    df = spark.createDataFrame([("a", at(0)), ("b", at(86400 * 3))], "k string, event_time timestamp")
    df.withColumn("event_date", F.to_date("event_time")).write.partitionBy("event_date").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    bound = before(instant(int(at(86400 * 3).timestamp() * 1e6)), hours=1)
    recent = rows_since(stored, "event_time", bound)
    assert as_set(recent, "k") == {("b",)}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line][0]
    assert "event_date" in filters.split("PushedFilters")[0]
