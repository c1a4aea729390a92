"""Fleet, latency, downtime, risk and ranking reports over the curated views.

``status`` is :func:`fleetlens.plans.semantic.current_status` (one row per machine),
``health`` the health windows, ``latency`` the per-event hop latencies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.bands import maintenance_band, risk_band, sensor_status
from fleetlens.functions.expr import as_time, before, count_if, instant, rows_since
from fleetlens.operators.metrics import SAVED_MEASURES, hop_columns
from fleetlens.operators.percentiles import (
    histogram,
    sample_metric,
    samples,
    weighted,
    weighted_percentiles,
    with_percentiles,
)
from fleetlens.plans.semantic import AsOf, with_line
from fleetlens.schemas import HORIZON_LABELS

HOPS = ("d2h", "h2b", "total")
PROBABILITY = {h: f"prob_fault_next_{h}" for h in HORIZON_LABELS}
WATCH_LIMIT = 0.5
_P50_P95 = (0.5, 0.95)


def _rows() -> Column:
    return F.count(F.lit(1))


def top_n(df: DataFrame, order: Sequence[str], n: int | None, tiebreak: Sequence[str]) -> DataFrame:
    """Sorted by ``order`` (``-name`` for descending) then ``tiebreak``, first ``n`` rows."""
    terms = [
        F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c)
        for c in [*order, *tiebreak]
    ]
    ranked = df.orderBy(*terms)
    return ranked if n is None else ranked.limit(n)


def rounded(df: DataFrame, digits: Mapping[str, tuple[str, int]]) -> list[Column]:
    """``{new name: (column, digits)}`` to rounded columns."""
    return [F.round(column, d).alias(name) for name, (column, d) in digits.items()]


def in_lists(df: DataFrame, **allowed: Sequence[str]) -> DataFrame:
    """Keep rows whose columns are in the given lists; an empty list does not filter."""
    for column, values in allowed.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


# Named filters; the time ones need ``as_of``.
def saved_filters(as_of: AsOf) -> dict[str, Column]:
    return {
        "high_risk": F.col("prob_fault_next_5m") >= 0.5,
        "critical_risk": F.col("prob_fault_next_5m") >= 0.8,
        "anomaly_detected": F.col("anomaly_score") >= 0.7,
        "running": F.col("state") == "RUN",
        "faulted": F.col("state") == "FAULT",
        "last_hour": F.col("event_time") >= before(as_of, hours=1),
        "last_day": F.col("event_time") >= before(as_of, days=1),
    }


def saved_measures(health: DataFrame, names: Sequence[str] = tuple(SAVED_MEASURES)) -> DataFrame:
    return health.agg(*[F.expr(SAVED_MEASURES[n]).alias(n) for n in names])


# ---- fleet ----------------------------------------------------------------------------------


def fleet_kpis(status: DataFrame) -> DataFrame:
    """One row of fleet cards: averages, watch counts per horizon, lags."""
    shown = [h for h in PROBABILITY if h != "1h"]
    return status.agg(
        F.avg("oee_pct").alias("fleet_oee_pct"),
        F.avg("anomaly_score").alias("avg_anomaly_score"),
        *[F.avg(PROBABILITY[h]).alias(f"avg_fault_risk_{h}") for h in shown],
        *[count_if(F.col(PROBABILITY[h]) >= WATCH_LIMIT).alias(f"watch_machines_{h}") for h in shown],
        F.avg("telemetry_lag_ms").alias("avg_telemetry_lag_ms"),
        F.avg("ml_lag_ms").alias("avg_ml_lag_ms"),
    )


_STATE_COUNTS = {"running": "RUN", "stopped": "STOPPED", "faulted": "FAULT"}


def _state_counts() -> list[Column]:
    return [count_if(F.col("state") == s).alias(name) for name, s in _STATE_COUNTS.items()]


def fleet_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        _rows().alias("total_machines"),
        *_state_counts(),
        F.round(F.avg("oee_pct"), 1).alias("avg_oee_pct"),
        F.round(F.avg("prob_fault_next_5m"), 3).alias("avg_fault_risk"),
        count_if(F.col("prob_fault_next_5m") >= 0.8).alias("critical_machines"),
        count_if(F.col("anomaly_score") >= 0.7).alias("anomaly_machines"),
    )


def explorer_kpis(status: DataFrame, **allowed: Sequence[str]) -> DataFrame:
    """Machines shown of all, by state, and their average OEE and risk, in one pass."""
    shown = F.lit(True)
    for column, values in allowed.items():
        if values:
            shown = shown & F.coalesce(F.col(column).isin(*values), F.lit(False))
    return status.agg(
        count_if(shown).alias("shown"),
        _rows().alias("total"),
        *[
            count_if(shown & (F.col("state") == s)).alias(name)
            for name, s in _STATE_COUNTS.items()
        ],
        F.avg(F.when(shown, F.col("oee_pct"))).alias("avg_oee_pct"),
        F.avg(F.when(shown, F.col("prob_fault_next_5m"))).alias("avg_risk"),
    )


def status_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        _rows().alias("row_count"),
        F.countDistinct("machine_id").alias("machine_count"),
        F.avg("prob_fault_next_5m").alias("avg_risk"),
        F.max("last_event_time").alias("latest_event"),
    )


def fleet_status(status: DataFrame) -> DataFrame:
    """Every machine with rounded readings and its risk band, riskiest first."""
    shown = {
        "temp_c": ("temp_c", 1),
        "vibration": ("vibration_mm_s", 2),
        "amps": ("current_amps", 1),
        "oee_pct": ("oee_pct", 1),
        "risk_5m": ("prob_fault_next_5m", 2),
    }
    ranked = top_n(status, ["-prob_fault_next_5m"], None, ["machine_id"])
    return ranked.select(
        "machine_id",
        "line_name",
        "state",
        "rpm",
        *rounded(status, shown),
        risk_band(F.col("prob_fault_next_5m")).alias("risk_band"),
    )


# ---- risk -----------------------------------------------------------------------------------


def risk_mix(status: DataFrame, as_of: AsOf, minutes: int = 10) -> DataFrame:
    recent = status.where(F.col("last_event_time") >= before(as_of, minutes=minutes))
    return recent.groupBy(risk_band(F.col("prob_fault_next_5m")).alias("risk_band")).agg(
        _rows().alias("machine_count")
    )


def risk_cards(status: DataFrame) -> DataFrame:
    """Machines per band and mean risk, machines without a prediction counting as 0."""
    level = risk_band(F.col("prob_fault_next_5m"))
    return status.agg(
        *[
            count_if(level == name).alias(f"{name.lower()}_machines")
            for name in ("CRITICAL", "WATCH", "NORMAL")
        ],
        F.avg(F.coalesce("prob_fault_next_5m", F.lit(0.0))).alias("avg_risk"),
    )


def fault_mix(silver: DataFrame, as_of: AsOf, minutes: int = 10, n: int = 10) -> DataFrame:
    recent = rows_since(silver, "event_time", before(as_of, minutes=minutes))
    counted = recent.groupBy(F.coalesce("fault_code", F.lit("NONE")).alias("fault_code")).agg(
        _rows().alias("records")
    )
    return top_n(counted, ["-records"], n, ["fault_code"])


def metric_summary(status: DataFrame, n: int = 200) -> DataFrame:
    columns = ["machine_id", "state", "oee_pct", "anomaly_score", "prob_fault_next_5m"]
    columns += ["telemetry_lag_ms", "ml_lag_ms", "last_event_time"]
    order = ["-prob_fault_next_5m", "-anomaly_score"]
    return top_n(status.select(*columns), order, n, ["machine_id"])


def flow_break_signals(status: DataFrame, n: int = 200) -> DataFrame:
    columns = ["machine_id", "state", "throughput_cpm", "vibration_mm_s", "temp_c", "current_amps"]
    columns += ["humidity_pct", "load_pct", "anomaly_score", "prob_fault_next_5m"]
    columns += ["telemetry_lag_ms", "last_event_time"]
    order = ["-prob_fault_next_5m", "-telemetry_lag_ms"]
    return top_n(status.select(*columns), order, n, ["machine_id"])


def risk_ranking(status: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All machines, longest horizon first in the order."""
    order = [f"-{PROBABILITY[h]}" for h in ("7d", "24h", "1h", "5m")]
    shown = ["machine_id", "state", "oee_pct", "anomaly_score", *PROBABILITY.values()]
    return top_n(status.select(*(columns or [*shown, "last_event_time"])), order, None, ["machine_id"])


def top_fault_risk(status: DataFrame, n: int = 10) -> DataFrame:
    shown = {
        "fault_risk_5m": ("prob_fault_next_5m", 3),
        "fault_risk_1h": ("prob_fault_next_1h", 3),
        "anomaly_score": ("anomaly_score", 3),
    }
    ranked = top_n(status, ["-prob_fault_next_5m"], n, ["machine_id"])
    return ranked.select(
        "machine_id",
        "line_name",
        *rounded(status, shown),
        "state",
        "fault_code",
        F.col("telemetry_lag_ms").alias("lag_ms"),
    )


def over_threshold(status: DataFrame, column: str, limit: float) -> DataFrame:
    """Machines at or over a limit, worst first."""
    shown = {
        "anomaly_score": ("anomaly_score", 3),
        "fault_risk_5m": ("prob_fault_next_5m", 3),
        "vibration": ("vibration_mm_s", 2),
        "temp_c": ("temp_c", 1),
    }
    found = top_n(status.where(F.col(column) >= limit), [f"-{column}"], None, ["machine_id"])
    return found.select("machine_id", "line_name", *rounded(status, shown), "state", "fault_code")


def drilldown(status: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Every machine with all readings, risks and its maintenance band."""
    band = maintenance_band(*[F.col(PROBABILITY[h]) for h in ("5m", "24h", "7d")])
    order = [f"-{PROBABILITY[h]}" for h in ("7d", "24h", "5m")] + ["-last_event_time"]
    joined = with_line(status.drop("line_name"), dim).withColumn("maintenance_band", band)
    columns = ["machine_id", "line_name", "state", "last_event_time", "telemetry_lag_ms", "ml_lag_ms"]
    columns += ["temp_c", "vibration_mm_s", "rpm", "current_amps", "humidity_pct", "throughput_cpm"]
    columns += ["load_pct", "power_kw", "power_factor", "voltage_v", "pressure_bar", "flow_rate_lpm"]
    columns += ["oee_pct", "anomaly_score", *PROBABILITY.values(), "maintenance_band"]
    return top_n(joined.select(*columns), order, None, ["machine_id"])


def machine_risks(status: DataFrame, machine_id: str) -> DataFrame:
    """All horizons of one machine."""
    shown = {f"risk_{h}": (c, 3) for h, c in PROBABILITY.items()}
    shown["anomaly"] = ("anomaly_score", 3)
    one = status.where(F.col("machine_id") == machine_id)
    return one.select("machine_id", *rounded(status, shown), "state", "fault_code")


# ---- OEE and downtime -----------------------------------------------------------------------

OEE_PARTS = ("oee_pct", "availability_pct", "performance_pct", "quality_pct")


def oee_by_window(health: DataFrame, start: AsOf, end: AsOf) -> DataFrame:
    columns = [F.col("machine_id"), F.col("window_end")]
    columns.append(F.date_trunc("HOUR", "window_end").alias("window_hour"))
    times = ["time_in_run_s", "time_in_stopped_s", "time_in_fault_s"]
    chosen = health.where(F.col("window_end").between(instant(start), instant(end)))
    return top_n(chosen.select(*columns, *OEE_PARTS, *times), ["-window_end"], None, ["machine_id"])


def oee_by_machine(status: DataFrame, dim: DataFrame | None = None, digits: int | None = 1):
    """OEE and its factors per machine, worst first; with a line when ``dim`` is given."""
    source = status if dim is None else with_line(status.drop("line_name"), dim)
    parts = [c if digits is None else F.round(c, digits).alias(c) for c in OEE_PARTS]
    lead = ["machine_id"] if dim is None else ["machine_id", "line_name"]
    return top_n(source, ["oee_pct"], None, ["machine_id"]).select(*lead, *parts, "state")


def downtime_by_machine(health: DataFrame, as_of: AsOf, hours: int = 1) -> DataFrame:
    recent = health.where(F.col("window_end") >= before(as_of, hours=hours))
    down = F.col("time_in_stopped_s") + F.col("time_in_fault_s")
    return recent.groupBy("machine_id").agg(F.sum(down).alias("downtime_s"))


def downtime_by_line(health: DataFrame, dim: DataFrame | None, as_of: AsOf, days: int = 1) -> DataFrame:
    """Downtime per line; windows are summed per machine before they meet the lines."""
    recent = health.where(F.col("window_end") >= before(as_of, days=days))
    per_machine = recent.groupBy("machine_id").agg(
        F.sum("time_in_fault_s").alias("_fault"),
        F.sum("time_in_stopped_s").alias("_stopped"),
        F.sum("oee_pct").alias("_oee"),
        F.count("oee_pct").alias("_windows"),
    )
    fault, stopped = F.sum("_fault"), F.sum("_stopped")
    totals = with_line(per_machine, dim).groupBy("line_name").agg(
        F.count("machine_id").alias("machines"),
        F.round(fault, 0).alias("fault_downtime_s"),
        F.round(stopped, 0).alias("planned_stop_s"),
        F.round(fault + stopped, 0).alias("total_downtime_s"),
        F.round(F.try_divide(F.sum("_oee"), F.sum("_windows")), 1).alias("avg_oee_pct"),
    )
    return top_n(totals, ["-total_downtime_s"], None, ["line_name"])


# ---- latency and freshness ------------------------------------------------------------------


def latency_stats(
    latency: DataFrame,
    as_of: AsOf,
    minutes: int = 10,
    machines: Sequence[str] = (),
    states: Sequence[str] = (),
    lines: Sequence[str] = (),
    hops: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per machine avg, max, p50 and p95 of each hop over the last minutes, in whole ms.

    ``hops`` names the hop columns of a site, see :func:`hop_columns`.
    """
    recent = latency.where(F.col("device_ts") >= before(as_of, minutes=minutes))
    chosen = in_lists(recent, machine_id=machines, state=states, line_name=lines)
    counted = _hop_counts(chosen, ["machine_id"], hops)
    cells = _hop_cells(("avg", "max"))
    found = counted.groupBy("machine_id").agg(*cells, samples().alias("sample_count"))
    return _with_p50_p95(found, HOPS)


def _hop_cells(kinds: Sequence[str], metrics: Sequence[str] = HOPS) -> list[Column]:
    """Per metric the asked aggregates (averages in whole ms) and its p50 and p95 as a pair."""
    cells = []
    for short in metrics:
        found = weighted(short)
        found["avg"] = F.round(found["avg"], 0)
        cells += [found[k].alias(f"{k}_{short}_ms") for k in kinds]
        cells.append(weighted_percentiles(short, _P50_P95).alias(f"_{short}"))
    return cells


def _with_p50_p95(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    columns = {}
    for short in metrics:
        for i, name in enumerate(("p50", "p95")):
            columns[f"{name}_{short}_ms"] = F.round(F.get(f"_{short}", F.lit(i)), 0)
    return df.withColumns(columns).drop(*[f"_{short}" for short in metrics])


def _hop_counts(latency: DataFrame, by: Sequence[str], hops: Mapping[str, str] | None = None) -> DataFrame:
    """Counted hop values per group, with what their percentiles need."""
    columns = {k: F.col(c) for k, c in (hops or hop_columns()).items()}
    counted = histogram(latency, by, columns | sample_metric())
    return with_percentiles(counted, by, dict.fromkeys(HOPS, _P50_P95))


def fleet_latency_rollup(stats: DataFrame) -> DataFrame:
    """Mean over machines of their averages and percentiles (a mean of percentiles)."""
    means = ["avg_d2h_ms", "avg_h2b_ms", "avg_total_ms", "p50_total_ms", "p95_total_ms"]
    return stats.agg(
        *[F.avg(c).alias(f"mean_of_{c}") for c in means], F.sum("sample_count").alias("samples")
    )


def hop_breakdown(
    latency: DataFrame, as_of: AsOf, minutes: int = 20, hops: Mapping[str, str] | None = None
) -> DataFrame:
    """One row: p50, p95, min, max and avg of each hop over the last minutes."""
    recent = latency.where(F.col("device_ts") > before(as_of, minutes=minutes))
    found = _hop_counts(recent, [], hops).agg(samples().alias("sample_count"), *_hop_cells(("min", "max", "avg")))
    return _with_p50_p95(found, HOPS)


def gold_lag_summary(latest: DataFrame) -> DataFrame:
    """One row: machines and p50, p95, min, max, avg of their telemetry lag."""
    values = {"lag": F.col("telemetry_lag_ms")} | sample_metric()
    cells = _hop_cells(("min", "max", "avg"), ["lag"])
    counted = with_percentiles(histogram(latest, [], values), [], {"lag": _P50_P95})
    found = counted.agg(samples().alias("machine_count"), *cells)
    return _with_p50_p95(found, ["lag"])


def latency_by_machine(silver: DataFrame, as_of: AsOf, hours: int = 1, n: int = 20) -> DataFrame:
    """Machines with the highest average hop latency over the last hours."""
    to_hub, to_bridge = F.col("device_to_hub_ms"), F.col("hub_to_bridge_ms")
    recent = rows_since(silver, "event_time", before(as_of, hours=hours)).where(to_hub.isNotNull())
    totals = recent.groupBy("machine_id").agg(
        F.round(F.avg(to_hub), 0).alias("avg_device_to_hub_ms"),
        F.round(F.avg(to_bridge), 0).alias("avg_hub_to_bridge_ms"),
        F.round(F.avg(to_hub + to_bridge), 0).alias("avg_total_latency_ms"),
        F.max(to_hub).alias("max_device_to_hub_ms"),
        F.max(to_bridge).alias("max_hub_to_bridge_ms"),
        _rows().alias("event_count"),
    )
    return top_n(totals, ["-avg_total_latency_ms"], n, ["machine_id"])


def bronze_recent(bronze: DataFrame, as_of: AsOf, minutes: int = 20) -> DataFrame:
    """Rows landed in the last minutes and the span they cover."""
    landed = bronze.select(as_time(bronze, "ingest_ts").alias("landed"))
    recent = landed.where(F.col("landed") > before(as_of, minutes=minutes))
    return recent.agg(
        _rows().alias("recent_records"),
        F.min("landed").alias("earliest"),
        F.max("landed").alias("latest"),
    )


def freshness_summary(status: DataFrame, as_of: AsOf) -> DataFrame:
    now = instant(as_of)
    age = (F.unix_millis(now) - F.unix_millis(F.max("last_event_time"))) / F.lit(1000.0)
    return status.agg(
        F.max("last_event_time").alias("latest_event"),
        F.max("telemetry_lag_ms").alias("max_lag_ms"),
        F.avg("telemetry_lag_ms").alias("avg_lag_ms"),
        F.countDistinct("machine_id").alias("machine_count"),
        _rows().alias("row_count"),
        F.when(age.isNotNull(), F.greatest(F.lit(0.0), age)).alias("age_seconds"),
    )


def lag_percentiles_approx(status: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Approximate p50/p95/p99 of both lags, in bounded memory."""
    cells = [_rows().alias("device_count")]
    for name in ("telemetry", "ml"):
        for q in (0.5, 0.95, 0.99):
            value = F.percentile_approx(f"{name}_lag_ms", F.lit(q), F.lit(accuracy))
            cells.append(value.alias(f"{name}_p{round(q * 100)}_ms"))
    return status.agg(*cells)


def lag_ranking(status: DataFrame, n: int | None = 20) -> DataFrame:
    columns = ["machine_id", "state", "last_event_time", "telemetry_lag_ms", "ml_lag_ms"]
    columns += ["prob_fault_next_5m", "anomaly_score"]
    order = ["-telemetry_lag_ms", "-ml_lag_ms"]
    return top_n(status.select(*columns), order, n, ["machine_id"])


def recent_status(mirror: DataFrame, n: int = 200) -> DataFrame:
    columns = mirror.select("machine_id", "state", "last_event_time")
    return top_n(columns, ["-last_event_time"], n, ["machine_id"])


def fleet_freshness_recent(status: DataFrame, as_of: AsOf, minutes: int = 5, n: int = 50):
    columns = ["machine_id", "state", "telemetry_lag_ms", "ml_lag_ms", "prob_fault_next_5m"]
    recent = status.where(F.col("last_event_time") >= before(as_of, minutes=minutes))
    order = ["telemetry_lag_ms", "-last_event_time"]
    return top_n(recent.select(*columns, "last_event_time"), order, n, ["machine_id"])


def mirror_delta(latest: DataFrame, mirror: DataFrame, machines: Sequence[str] = ()) -> DataFrame:
    """How far the mirror's last event lags the gold table's, per machine, in ms."""
    gold = in_lists(latest, machine_id=machines).select(
        "machine_id", F.col("last_event_time").alias("gold_event_time")
    )
    copy = mirror.select("machine_id", F.col("last_event_time").alias("mirror_event_time"))
    delta = F.unix_millis("mirror_event_time") - F.unix_millis("gold_event_time")
    return gold.join(copy, "machine_id").withColumn("sync_delta_ms", delta)


ENRICHMENT = ("line_name", *OEE_PARTS, "anomaly_score", "prob_fault_next_5m")
ENRICHMENT += ("anomaly_inference_type", "fault_inference_type")


def enrich_live(live: DataFrame, status: DataFrame, as_of: AsOf) -> DataFrame:
    """Mirror rows with the curated view's scores and line, lag measured at ``as_of``."""
    lag = F.unix_millis(instant(as_of)) - F.unix_millis("last_event_time")
    known = [c for c in ENRICHMENT if c in status.columns]
    joined = live.withColumn("telemetry_lag_ms", lag).join(
        status.select("machine_id", *known), "machine_id", "left"
    )
    absent = {c: F.lit(None).cast("double") for c in ENRICHMENT if c not in known}
    return joined.withColumns(absent) if absent else joined


# ---- work-order text ------------------------------------------------------------------------


def summary_lines(status: DataFrame) -> DataFrame:
    """One line of text per machine: state, readings with their limits, OEE and risks."""

    def shown(column: str, digits: int | None) -> Column:
        value = F.coalesce(F.col(column), F.lit(0))
        return (value if digits is None else F.round(value, digits)).cast("string")

    pieces: list[str | Column] = ["Machine ", F.col("machine_id"), ": state="]
    pieces.append(F.coalesce("state", F.lit("UNKNOWN")))
    for label, column, digits, unit in (
        ("vibration", "vibration_mm_s", 2, " mm/s"),
        ("temp", "temp_c", 1, "C"),
        ("current", "current_amps", 2, "A"),
    ):
        pieces += [f", {label}=", shown(column, digits), f"{unit} [", sensor_status(column), "]"]
    for label, column, digits, unit in (
        ("throughput", "throughput_cpm", None, " cpm"),
        ("rpm", "rpm", None, ""),
        ("OEE", "oee_pct", 1, "%"),
        ("anomaly_score", "anomaly_score", 3, ""),
        ("fault_risk_5m", "prob_fault_next_5m", 3, ""),
        ("fault_risk_1h", "prob_fault_next_1h", 3, ""),
    ):
        pieces += [f", {label}=", shown(column, digits), unit]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    return status.select("machine_id", text.alias("summary"))


def machine_summary_text(status: DataFrame, machine_ids: Sequence[str]) -> DataFrame:
    """The lines of the named machines as one text, in machine order.

    The list bounds the text; use :func:`summary_lines` for a whole fleet.
    """
    if not machine_ids:
        raise ValueError("name the machines to describe")
    lines = summary_lines(in_lists(status, machine_id=machine_ids))
    ordered = F.sort_array(F.collect_list(F.struct("machine_id", "summary")))
    return lines.agg(F.array_join(F.transform(ordered, lambda r: r["summary"]), "\n").alias("summary"))


LOCAL_ZONE = "America/Detroit"  # fixed value: zone the plant reads times in


def localize(df: DataFrame, columns: Sequence[str], zone: str = LOCAL_ZONE) -> DataFrame:
    """Wall-clock time of a zone for UTC instants."""
    return df.withColumns(
        {c: F.from_utc_timestamp(c, zone).cast("timestamp_ntz") for c in columns}
    )


def valid_machine_ids(df: DataFrame) -> DataFrame:
    """Distinct machine ids with whether they follow the MC-NNNN form."""
    ids = df.select("machine_id").distinct()
    return ids.withColumn("valid", F.col("machine_id").rlike(r"^MC-\d{4}$"))
