"""Value bands: tables of cuts turned into one CASE expression.

A band is a list of ``(operator, limit, label)`` tried from the top, with a
label for what is left.  Adding a band means adding a table row, not code.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Cut = tuple[str, float, str]
_TESTS = {
    ">=": operator.ge,
    ">": operator.gt,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
}


def band(value: Column, cuts: Sequence[Cut], otherwise: str, missing: str | None = None) -> Column:
    """Label of the first cut that ``value`` meets, ``missing`` for NULL if given."""
    chain = F
    if missing is not None:
        chain = chain.when(value.isNull(), F.lit(missing))
    for test, limit, label in cuts:
        chain = chain.when(_TESTS[test](value, F.lit(limit)), F.lit(label))
    return chain.otherwise(F.lit(otherwise))


# Limits and labels.
RISK = [(">=", 0.8, "CRITICAL"), (">=", 0.5, "WATCH")]
LATENCY_MS = [("<", 10000, "✓ <10s"), ("<", 30000, "⚠ 10-30s")]
LATENCY_OTHERWISE = "✗ >30s"
AGE_SECONDS = [("<", 120, "green"), ("<", 600, "amber")]
OEE = [(">=", 80, "good"), (">=", 50, "fair")]
AVERAGE_RISK = [(">=", 0.5, "high"), (">=", 0.2, "elevated")]
HOP_MS = [("<", 1000, "good"), ("<", 5000, "fair")]
VIBRATION = [(">=", 9.5, "FAULT"), (">=", 8, "WARNING")]
TEMPERATURE = [(">=", 85, "FAULT"), (">=", 75, "WARNING")]
CURRENT = [(">=", 12, "FAULT"), (">=", 10, "WARNING")]
RPM = [("=", 0, "STOPPED"), (">", 2800, "OVERSPEED")]
HUMIDITY = [(">", 70, "ELEVATED")]
THROUGHPUT = [("=", 0, "STOPPED"), ("<", 30, "DEGRADED")]
# Sensor limits used in work-order text: unit, upper limit, warning limit.
SENSOR_LIMITS = {
    "vibration_mm_s": ("", 9.5, 8.0),
    "temp_c": ("C", 85, 75),
    "current_amps": ("A", 12, 10),
}
# Gauge ranges: low, high, warning from, fault from.
GAUGES = {
    "vibration_mm_s": (0, 15, 8, 9.5),
    "temp_c": (0, 120, 75, 85),
    "current_amps": (0, 16, 10, 12),
}
SENSOR_BANDS = {
    "vibration_mm_s": VIBRATION,
    "temp_c": TEMPERATURE,
    "current_amps": CURRENT,
    "rpm": RPM,
    "humidity_pct": HUMIDITY,
    "throughput_cpm": THROUGHPUT,
}


def risk_band(probability: Column) -> Column:
    """CRITICAL / WATCH / NORMAL; a machine without a prediction counts as risk 0."""
    return band(F.coalesce(probability, F.lit(0.0)), RISK, "NORMAL")


def maintenance_band(p5m: Column, p24h: Column, p7d: Column) -> Column:
    """The most urgent horizon that passes its own limit."""
    return (
        F.when(p5m >= 0.8, "CRITICAL_NOW")
        .when(p24h >= 0.6, "PLAN_24H")
        .when(p7d >= 0.5, "PLAN_7D")
        .otherwise("NORMAL")
    )


def latency_status(lag_ms: Column) -> Column:
    return band(lag_ms, LATENCY_MS, LATENCY_OTHERWISE)


def sensor_status(sensor: str) -> Column:
    """OVER THRESHOLD / WARNING / OK with the limit spelled out; limits are exclusive."""
    unit, over, warn = SENSOR_LIMITS[sensor]
    cuts = [
        (">", over, f"OVER THRESHOLD (>{over}{unit})"),
        (">", warn, f"WARNING (>{warn}{unit})"),
    ]
    return band(F.col(sensor), cuts, "OK")


def vibration_status(vibration: Column) -> Column:
    """FAULT / WARNING / NORMAL; unlike :func:`sensor_status` the limits are inclusive."""
    return band(vibration, VIBRATION, "NORMAL")


def sensor_band(sensor: str) -> Column:
    return band(F.col(sensor), SENSOR_BANDS[sensor], "NORMAL", missing="UNKNOWN")


def gauge_fraction(sensor: str) -> Column:
    """Needle position of a gauge, 0 to 1."""
    low, high = GAUGES[sensor][:2]
    share = (F.col(sensor) - F.lit(float(low))) / F.lit(float(high - low))
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def freshness_band(age_s: Column) -> Column:
    return band(age_s, AGE_SECONDS, "red", missing="grey")


def age_label(age_s: Column) -> Column:
    """``42s ago``, ``3.5m ago``, ``2.0h ago``, ``n/a``; exact ties round to even."""
    seconds = age_s.cast("double")

    def shown(value: Column, digits: int, unit: str) -> Column:
        plain = F.translate(F.format_number(value, digits), ",", "")
        return F.concat(plain, F.lit(f"{unit} ago"))

    return (
        F.when(age_s.isNull(), F.lit("n/a"))
        .when(seconds < 60, shown(seconds, 0, "s"))
        .when(seconds < 3600, shown(seconds / 60, 1, "m"))
        .otherwise(shown(seconds / 3600, 1, "h"))
    )


def oee_band(oee_pct: Column) -> Column:
    return band(oee_pct, OEE, "poor")


def average_risk_band(risk: Column) -> Column:
    return band(risk, AVERAGE_RISK, "low")


def hop_band(millis: Column) -> Column:
    return band(millis, HOP_MS, "slow", missing="unknown")
