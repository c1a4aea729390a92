import pytest
from pyspark.sql import functions as F

from fleetlens.functions import bands
from fleetlens.functions.scores import horizon_expand


def labels(spark, column, values, kind="double"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "fn, values, want",
    [
        (bands.risk_band, [0.4999, 0.5, 0.7999, 0.8, None], ["NORMAL", "WATCH", "WATCH", "CRITICAL", "NORMAL"]),
        (bands.vibration_status, [7.9, 8.0, 9.5, None], ["NORMAL", "WARNING", "FAULT", "NORMAL"]),
        (bands.latency_status, [9999.0, 10000.0, 30000.0], ["✓ <10s", "⚠ 10-30s", "✗ >30s"]),
        (bands.freshness_band, [119.0, 120.0, 600.0, None], ["green", "amber", "red", "grey"]),
        (bands.oee_band, [80.0, 50.0, 49.9], ["good", "fair", "poor"]),
        (bands.average_risk_band, [0.5, 0.2, 0.1], ["high", "elevated", "low"]),
        (bands.hop_band, [999.0, 1000.0, 5000.0, None], ["good", "fair", "slow", "unknown"]),
        (bands.age_label, [59.0, 60.0, 135.0, 3600.0, None], ["59s ago", "1.0m ago", "2.2m ago", "1.0h ago", "n/a"]),
    ],
)
def test_limits(spark, fn, values, want):
    assert labels(spark, fn, values) == want


def test_sensor_limits_are_exclusive_in_work_orders(spark):
    df = spark.createDataFrame([(8.0,), (8.1,), (9.5,), (9.6,), (None,)], "vibration_mm_s double")
    got = [r[0] for r in df.select(bands.sensor_status("vibration_mm_s")).collect()]
    assert got == ["OK", "WARNING (>8.0)", "WARNING (>8.0)", "OVER THRESHOLD (>9.5)", "OK"]


def test_sensor_bands(spark):
    df = spark.createDataFrame([(0,), (29,), (30,), (None,)], "throughput_cpm int")
    got = [r[0] for r in df.select(bands.sensor_band("throughput_cpm")).collect()]
    assert got == ["STOPPED", "DEGRADED", "NORMAL", "UNKNOWN"]
    df = spark.createDataFrame([(2800,), (2801,)], "rpm int")
    assert [r[0] for r in df.select(bands.sensor_band("rpm")).collect()] == ["NORMAL", "OVERSPEED"]


def test_maintenance_order(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.9), (0.1, 0.6, 0.9), (0.1, 0.1, 0.5), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(bands.maintenance_band(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["CRITICAL_NOW", "PLAN_24H", "PLAN_7D", "NORMAL"]


def test_horizons_grow_and_stay_probabilities(spark):
    df = spark.createDataFrame([(v,) for v in (-0.5, 0.0, 1e-6, 0.01, 0.5, 1.0, 7.0, None)], "p double")
    for row in df.select(*horizon_expand(F.col("p")).values()).collect():
        if row[0] is None:
            assert set(row) == {None}
        else:
            assert list(row) == sorted(row) and 0 <= row[0] and row[-1] <= 1
