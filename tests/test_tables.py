"""Latest rows, keyed tables, metric views, reports and requests."""

import os
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import latest, metrics
from fleetlens.operators.scoring import rule_alerts, score_windows
from fleetlens.plans import reports, requests, semantic
from fleetlens.session import bounded_broadcast
from fleetlens.sinks.keyed import KeyedTable, export_training, publish_scores, upsert_parquet
from tests.conftest import as_set, at

ROWS = "k string, t timestamp, v int"


def test_latest_ties_nulls_and_empty(spark):
    df = spark.createDataFrame(
        [("a", at(1), 1), ("a", at(1), 2), ("b", None, 9), ("b", at(0), 3), ("c", None, 4), ("d", at(5), None)], ROWS
    )
    want = {("a", at(1), 2), ("b", at(0), 3), ("c", None, 4), ("d", at(5), None)}
    assert as_set(latest.latest_by_key(df, ["k"], ["t"])) == want
    assert latest.latest_by_key(df, ["k"], ["t"]).columns == ["k", "t", "v"]
    assert latest.latest_by_key(df.where("false"), ["k"], ["t"]).count() == 0


def test_latest_equals_row_number(frames):
    names = frames.silver.columns
    got = latest.latest_by_key(frames.silver, ["machine_id"], ["event_time"], ["event_id"])
    ranked = frames.silver.selectExpr(
        "*", "row_number() over (partition by machine_id order by event_time desc, event_id desc) rn"
    )
    assert as_set(got, *names) == as_set(ranked.where("rn = 1"), *names)


def test_latest_sends_one_row_per_key_and_task(spark, frames):
    plan = latest.latest_by_key(frames.silver, ["machine_id"], ["event_time"])._jdf.queryExecution()
    text = plan.sparkPlan().toString()
    assert "partial_max" in text and "Window" not in text


def test_changed_rows(spark):
    old = spark.createDataFrame([("a", at(0), 1), ("b", at(0), None), ("c", at(0), 3)], ROWS)
    new = spark.createDataFrame([("a", at(0), 1), ("b", at(0), None), ("c", at(1), 3), ("d", None, None)], ROWS)
    got = latest.changed_rows(old, new, ["k"])
    assert as_set(got) == {("c", at(1), 3, "update"), ("d", None, None, "insert")}


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ("k",), ("t",))
    assert table.read() is None
    first = spark.createDataFrame([("a", at(1), 1), ("b", at(1), 1)], ROWS)
    assert table.upsert(first, "1")
    second = spark.createDataFrame([("a", at(0), 9), ("b", at(1), 2), ("c", at(0), 3)], ROWS)
    assert table.upsert(second, "2")
    want = {("a", at(1), 1), ("b", at(1), 2), ("c", at(0), 3)}  # older row ignored, equal time replaced
    assert as_set(table.read()) == want
    assert not table.upsert(first, "2")  # a replayed batch changes nothing
    assert as_set(table.read()) == want
    # A half-written version does not count.
    (tmp_path / "t" / "change=000000000003__x").mkdir()
    assert as_set(table.read()) == want
    assert table.upsert(spark.createDataFrame([("d", at(9), 9)], ROWS), "3")
    assert as_set(table.read()) == want | {("d", at(9), 9)}
    want |= {("d", at(9), 9)}
    assert not table.compact(after=4) and table.drop_old(0) == 0
    reader = table.read()
    assert table.compact(after=3) and as_set(table.read()) == want == as_set(reader)
    assert table.drop_old() == 0  # the reader keeps its files
    assert table.drop_old(older_than_s=0) == 3 and as_set(table.read()) == want
    assert table.upsert(spark.createDataFrame([("a", at(0), 7), ("d", at(9), 8)], ROWS), "4")
    assert as_set(table.read()) == (want - {("d", at(9), 9)}) | {("d", at(9), 8)}


def test_old_folders_go_while_the_table_keeps_changing(spark, tmp_path):
    """100 short batches: a folder goes by the age of the copy that replaced it, so few are left at any time."""
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), ("t",))
    batch = spark.createDataFrame([("a", at(1), 1)], ROWS).coalesce(1)
    most, dropped = 0, 0
    for number in range(100):
        table.upsert(batch, f"b{number}")
        table.compact(after=5)
        dropped += table.drop_old(older_than_s=1.0)
        most = max(most, len(list((tmp_path / "t").iterdir())))
    assert dropped >= 80 and most <= 40
    assert as_set(table.read()) == {("a", at(1), 1)}


def test_only_folders_replaced_long_ago_go(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), ("t",))
    for number in range(4):
        table.upsert(spark.createDataFrame([("a", at(number), number)], ROWS), f"b{number}")
        if number % 2:
            table.compact(after=1)
    names = [(p.number, p.full) for p in table.versions()]
    assert names == [(1, False), (2, False), (2, True), (3, False), (4, False), (4, True)]
    first_copy = tmp_path / "t" / "full=000000000002__compact" / "_SUCCESS"
    hour_ago = time.time() - 3700
    os.utime(first_copy, (hour_ago, hour_ago))
    assert table.drop_old() == 2  # what the first copy replaced; the second copy is too young
    assert [(p.number, p.full) for p in table.versions()] == names[2:]


def test_upsert_writes_only_what_changed(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), ("t",))
    table.upsert(spark.createDataFrame([(f"k{i}", at(1), i) for i in range(100)], ROWS), "load")
    table.upsert(spark.createDataFrame([("k7", at(2), -1)], ROWS), "one")
    assert spark.read.parquet(table.versions()[-1].folder).count() == 1
    assert table.read().count() == 100


def test_keyed_table_gains_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_parquet(spark, path, spark.createDataFrame([("a", at(1))], "k string, t timestamp"), ["k"], ["t"])
    wider = spark.createDataFrame([("b", at(1), 5)], ROWS)
    table = upsert_parquet(spark, path, wider, ["k"], ["t"])
    assert as_set(table.read(), "k", "v") == {("a", None), ("b", 5)}


def test_publish_scores_equals_latest_of_history(spark, frames, tmp_path):
    history, current = str(tmp_path / "h"), str(tmp_path / "c")
    scores = frames.anomaly.drop("event_id")
    half = F.col("event_time") < F.timestamp_micros(F.lit(frames.as_of - 9_000_000_000))
    publish_scores(scores.where(half), history, current)
    table = publish_scores(scores.where(~half), history, current)
    stored = spark.read.parquet(history)
    assert stored.count() == scores.count()
    want = latest.latest_by_key(stored, ["machine_id"], ["event_time"])
    assert as_set(table.read(), "machine_id", "event_time") == as_set(want, "machine_id", "event_time")


def test_export_formats_hold_the_same_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.5), ("b", None, None)], "k string, v int, x double")
    targets = export_training(df, str(tmp_path))
    for kind, path in targets.items():
        reader = spark.read.schema(df.schema)
        back = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
        assert as_set(back) == as_set(df)


def test_metric_view_grain_and_nulls(spark):
    df = spark.createDataFrame(
        [("m1", None, at(0), 10), ("m1", "L", at(0), 20), ("m2", "L", at(1), 40)],
        "machine_id string, line_name string, device_ts timestamp, x bigint",
    ).withColumn("state", F.lit("RUN"))
    hops = {c: F.col("x") for c in ("hop1_device_to_hub_ms", "hop2_hub_to_bronze_ms", "total_device_to_bronze_ms")}
    df = df.withColumns(hops)
    got = metrics.LATENCY.query(df, ["record_count", "avg_total_ms", "p50_total_ms"], ["line"])
    assert as_set(got) == {(None, 1, 10.0, 10.0), ("L", 2, 30.0, 30.0)}
    total = metrics.LATENCY.query(df, ["p50_total_ms", "record_count"]).first()
    assert tuple(total) == (20.0, 3)
    only = metrics.LATENCY.query(df, ["p95_total_ms"], ["machine"], where="machine_id = 'm2'")
    assert as_set(only) == {("m2", 40.0)}
    near = metrics.LATENCY.query(df, ["p50_total_ms", "record_count"], approx=True).first()
    assert tuple(near) == (20, 3)
    with pytest.raises(KeyError):
        metrics.LATENCY.query(df, ["nothing"])


def test_downtime_pct_of_nothing_is_null(spark):
    df = spark.createDataFrame([("m", at(0), 0.0, 0.0, 0.0)], "machine_id string, window_end timestamp, time_in_run_s double, time_in_stopped_s double, time_in_fault_s double")
    assert metrics.DOWNTIME.query(df, ["downtime_pct"]).first()[0] is None


def test_line_names(spark):
    df = spark.createDataFrame([("MC-0000",), ("MC-0012",), ("MC-7",), ("LINE-X",), ("xMC-1",)], "machine_id string")
    got = dict(df.select("machine_id", semantic.line_name(F.col("machine_id"))).collect())
    assert got == {
        "MC-0000": "Physical Line 0000", "MC-0012": "Virtual Line 0012", "MC-7": "Virtual Line 7",
        "LINE-X": "Unknown Line", "xMC-1": "Unknown Line",
    }


def test_live_window_is_at_least_an_hour(frames):
    got = semantic.telemetry_live(frames.silver, frames.as_of, hours=0)
    assert got.count() == semantic.telemetry_live(frames.silver, frames.as_of, hours=1).count() > 0


def test_hop_names_are_free(frames):
    got = semantic.hop_latency(frames.bronze, frames.dim, hub="gate", store="lake")
    assert {"gate_ts", "hop2_gate_to_lake_ms", "total_device_to_lake_ms"} <= set(got.columns)


def test_views_build_in_order_and_use_stored_ones(spark, frames):
    tables = {
        "silver_machine_telemetry": frames.silver,
        "bronze_iot_telemetry": frames.bronze,
        "gold_machine_health_5m": frames.gold,
        "gold_machine_current_status": frames.status10,
        "ml_anomaly_scores": frames.anomaly,
        "ml_fault_predictions": frames.fault.drop("prob_fault_next_7d"),
    }
    order = semantic.register_views(tables, frames.as_of, hub="x", store="y")
    assert order.index("dim_machine") < order.index("vw_pipeline_latency")
    assert "hop1_device_to_x_ms" in spark.table("vw_pipeline_latency").columns
    assert spark.sql("select count(prob_fault_next_7d) from vw_machine_current_status").first()[0] == 0
    again = semantic.register_views({**tables, "dim_machine": frames.dim}, frames.as_of)
    assert "dim_machine" not in again
    with pytest.raises(KeyError):
        semantic.register_views({"silver_machine_telemetry": frames.silver}, frames.as_of)


def test_health_without_scores_falls_back_to_rules(frames):
    got = semantic.machine_health(frames.gold, frames.anomaly.where("false"), frames.fault.where("false"))
    rule = frames.gold.select("machine_id", "window_start", "anomaly_score", F.col("rule_based_risk_score").alias("prob_fault_next_5m"))
    assert as_set(got, *rule.columns) == as_set(rule)
    assert got.where("predicted_fault_next_5m <> (prob_fault_next_5m >= 0.5)").count() == 0
    assert got.where("last_ml_score_time is not null").count() == 0


def test_small_joins_are_not_forced(frames):
    hints = frames.status._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in hints


def test_summary_text_needs_machines(frames):
    with pytest.raises(ValueError):
        reports.machine_summary_text(frames.status, [])
    text = reports.machine_summary_text(frames.status, ["MC-0003", "MC-0000"]).first()["summary"]
    lines = {r["machine_id"]: r["summary"] for r in reports.summary_lines(frames.status).collect()}
    assert text == lines["MC-0000"] + "\n" + lines["MC-0003"]


def test_top_n_is_deterministic(frames):
    some = reports.top_n(frames.status.select("machine_id", "state"), ["state"], 5, ["machine_id"])
    assert some.collect() == some.collect() and some.count() == 5
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_modes_and_alerts(spark, frames):
    both = score_windows(frames.silver, frames.as_of, batch_hours=1, realtime_minutes=10)
    counted = dict(both.groupBy("inference_type").count().collect())
    assert counted["realtime"] < counted["batch"]
    only = score_windows(frames.silver, frames.as_of, modes=["realtime"])
    assert only.count() == counted["realtime"]
    with pytest.raises(ValueError):
        score_windows(frames.silver, frames.as_of, modes=["never"])
    alerts = rule_alerts(frames.silver, frames.as_of)
    assert alerts.where("state <> 'RUN' or vibration_mm_s <= 8 or temp_c <= 85").count() == 0


def test_service_requests(spark, frames):
    wanted = spark.createDataFrame(
        [("MC-0001", "HIGH", "INSPECTION", "d", "me", 0), ("MC-0002", "LOW", "REPAIR", "d", "me", 1), ("X", "LOW", "INSPECTION", "d", "me", 2)],
        "machine_id string, priority string, request_type string, description string, requestor string, position int",
    )
    assert as_set(requests.invalid_requests(wanted), "machine_id", "reason") == {("MC-0002", "request_type"), ("X", "machine_id")}
    made = requests.sr_create(wanted, "abc", frames.as_of)
    assert as_set(made, "id", "status") == {("abc-0", "OPEN"), ("abc-1", "OPEN"), ("abc-2", "OPEN")}
    single = requests.sr_create(wanted.limit(1).drop("position"), "abc", frames.as_of)
    assert as_set(single, "id") == {("abc",)}
    changes = spark.createDataFrame([("abc-1", "CLOSED"), ("nope", "CLOSED")], "id string, status string")
    assert as_set(requests.sr_apply_status(made, changes, frames.as_of), "id", "status") == {("abc-1", "CLOSED")}
    counts = dict(requests.sr_status_counts(made, ["OPEN", "CLOSED"]).collect())
    assert counts == {"OPEN": 3, "CLOSED": 0}


@pytest.mark.parametrize("sort, want", [("newest", "cba"), ("oldest", "abc"), ("priority", "bca")])
def test_request_order(spark, sort, want):
    df = spark.createDataFrame(
        [("a", "SOON", at(1)), ("b", "CRITICAL", at(2)), ("c", "LOW", at(3))], "id string, priority string, created_at timestamp"
    )
    assert "".join(r["id"] for r in requests.sr_sorted(df, sort).collect()) == want


def test_hop_names_of_a_site(frames):
    own = semantic.hop_latency(frames.bronze, frames.dim, hub="broker", store="lake")
    hops = metrics.hop_columns("broker", "lake")
    stats = reports.latency_stats(own, frames.as_of, minutes=30, hops=hops)
    assert as_set(stats) == as_set(reports.latency_stats(frames.latency, frames.as_of, minutes=30))
    view = metrics.latency_view("broker", "lake").query(own)
    assert view.first()["p95_broker_to_lake_ms"] == metrics.LATENCY.query(frames.latency).first()["p95_hub_to_bronze_ms"]
    assert reports.hop_breakdown(own, frames.as_of, hops=hops).count() == 1


def test_broadcast_counts_what_nested_columns_hold(spark):
    def hinted(df, **bounds):
        return "broadcast" in bounded_broadcast(df, **bounds)._jdf.queryExecution().logical().toString().lower()

    wide = spark.range(10).select("id", F.array_repeat(F.lit(1.0), 100_000).alias("v"))  # 8 MB
    assert not hinted(wide, max_bytes=1 << 20) and hinted(wide, max_bytes=64 << 20)
    names = spark.range(10).select(F.array_repeat(F.lit("x" * 1000), 1000).alias("names"))  # 10 MB
    assert not hinted(names, max_bytes=1 << 20)
    nested = spark.range(10).select(F.struct(F.array_repeat(F.lit(1), 100_000).alias("a"), F.lit("b").alias("b")).alias("s"))
    assert not hinted(nested, max_bytes=1 << 20) and hinted(nested)
    mapped = spark.range(10).select(F.create_map(F.lit("k"), F.repeat(F.lit("v"), 500_000)).alias("m"))
    assert not hinted(mapped, max_bytes=1 << 20) and hinted(mapped)
    assert hinted(spark.range(1000)) and not hinted(spark.range(1000), max_rows=999)
    empty = spark.createDataFrame([(None, None)], "a array<array<string>>, s struct<x: decimal(9,2)>")
    assert hinted(empty)
    unknown = spark.sql("select parse_json('[1]') as v")
    assert not hinted(unknown)
