"""Metric views: measures defined once, aggregated at whatever grain a query asks for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.percentiles import (
    histogram,
    sample_metric,
    samples,
    weighted,
    weighted_percentiles,
    with_percentiles,
)


@dataclass(frozen=True)
class Of:
    """Measure: avg, min, max, sum or count_if of a column; next to percentiles, of an integer column."""

    how: str
    column: str


@dataclass(frozen=True)
class Ratio:
    """Measure: sum of one column over the sum of another, times ``scale``; NULL over 0."""

    upper: str
    lower: str
    scale: int = 1

    @property
    def parts(self) -> tuple[Of, Of]:
        return Of("sum", self.upper), Of("sum", self.lower)


@dataclass(frozen=True)
class Percentile:
    """Measure: exact percentile ``q`` of an integer column."""

    column: str
    q: float


COUNT = "count(1)"


@dataclass(frozen=True)
class MetricView:
    """Named dimensions and measures over one source.

    ``dimensions`` and ``measures`` map a name to a SQL expression over the source;
    a measure may also be :class:`Of`, :class:`Ratio` or :class:`Percentile`.  A query
    aggregates source rows, so ratios and averages are right at every grain;
    ``partials`` answers the same from stored partial aggregates.
    """

    name: str
    dimensions: Mapping[str, str]
    measures: Mapping[str, str | Of | Ratio | Percentile]

    def query(
        self,
        source: DataFrame,
        measures: Sequence[str] | None = None,
        by: Sequence[str] = (),
        where: Column | str | None = None,
        approx: bool = False,
    ) -> DataFrame:
        """Measures per combination of the ``by`` dimensions (one row for none)."""
        names = list(self.measures) if measures is None else list(measures)
        unknown = [n for n in [*names, *by] if n not in self.measures and n not in self.dimensions]
        if unknown:
            raise KeyError(f"{self.name} has no {unknown}")
        rows = source if where is None else source.where(where)
        dims = [F.expr(self.dimensions[d]).alias(d) for d in by]
        wanted = {n: self.measures[n] for n in names}
        if approx or not any(isinstance(m, Percentile) for m in wanted.values()):
            return rows.groupBy(*dims).agg(*[_plain(m).alias(n) for n, m in wanted.items()])
        return self._counted(rows, dims, by, wanted)

    def _counted(self, rows: DataFrame, dims, by: Sequence[str], wanted: Mapping) -> DataFrame:
        """All measures from one pass that counts equal values before it aggregates."""
        mixed = [n for n, m in wanted.items() if isinstance(m, (str, Ratio)) and m != COUNT]
        if mixed:
            raise ValueError(f"ask for {mixed} apart from percentiles")
        columns = {m.column: F.col(m.column) for m in wanted.values() if not isinstance(m, str)}
        counted = histogram(rows.select(*dims, *columns), by, columns | sample_metric())
        asked: dict[str, list[float]] = {}
        for m in wanted.values():
            if isinstance(m, Percentile):
                asked.setdefault(m.column, []).append(m.q)
        cells = [weighted_percentiles(c, qs).alias(f"_{c}") for c, qs in asked.items()]
        outputs = []
        for name, m in wanted.items():
            if isinstance(m, Percentile):
                outputs.append(F.get(f"_{m.column}", F.lit(asked[m.column].index(m.q))).alias(name))
            else:
                cells.append((weighted(m.column)[m.how] if isinstance(m, Of) else samples()).alias(name))
                outputs.append(name)
        return with_percentiles(counted, by, asked).groupBy(*by).agg(*cells).select(*by, *outputs)


def _plain(measure: str | Of | Ratio | Percentile) -> Column:
    if isinstance(measure, Of):
        return F.expr(f"{measure.how}({measure.column})")
    if isinstance(measure, Ratio):
        return F.expr(f"sum({measure.upper}) / nullif(sum({measure.lower}), 0) * {measure.scale}")
    if isinstance(measure, Percentile):
        return F.percentile_approx(measure.column, F.lit(measure.q), F.lit(10_000))
    return F.expr(measure)


def _time_dimensions(column: str, prefix: str, hour: bool = True) -> dict[str, str]:
    out = {f"{prefix}_date": f"date({column})"}
    if hour:
        out[f"{prefix}_hour"] = f"date_trunc('HOUR', {column})"
    return out


def _averages(columns: Mapping[str, str]) -> dict[str, Of]:
    return {name: Of("avg", column) for name, column in columns.items()}


_RISKS = {f"fault_risk_{h}": f"prob_fault_next_{h}" for h in ("5m", "1h", "24h", "7d")}


def hop_columns(hub: str = "hub", store: str = "bronze") -> dict[str, str]:
    """Columns of the latency view of a site: first hop, second hop, both."""
    return {
        "d2h": f"hop1_device_to_{hub}_ms",
        "h2b": f"hop2_{hub}_to_{store}_ms",
        "total": f"total_device_to_{store}_ms",
    }



TELEMETRY = MetricView(
    "mv_machine_telemetry",
    {
        "machine": "machine_id",
        "state": "state",
        "event_time": "event_time",
        **_time_dimensions("event_time", "event"),
    },
    {
        "event_count": COUNT,
        **_averages(
            {
                "avg_temp_c": "temp_c",
                "avg_vibration_mm_s": "vibration_mm_s",
                "avg_throughput_cpm": "throughput_cpm",
                "avg_load_pct": "load_pct",
                "avg_power_kw": "power_kw",
                "avg_pressure_bar": "pressure_bar",
                "avg_flow_lpm": "flow_rate_lpm",
            }
        ),
    },
)
OEE = MetricView(
    "mv_machine_oee",
    {"machine": "machine_id", "window_end": "window_end", **_time_dimensions("window_end", "window")},
    _averages({c: c for c in ("oee_pct", "availability_pct", "performance_pct", "quality_pct")}),
)
_DOWN = "time_in_stopped_s + time_in_fault_s"
DOWNTIME = MetricView(
    "mv_machine_downtime",
    {
        "machine": "machine_id",
        "window_end": "window_end",
        **_time_dimensions("window_end", "window", hour=False),
    },
    {
        "run_seconds": Of("sum", "time_in_run_s"),
        "stopped_seconds": Of("sum", "time_in_stopped_s"),
        "fault_seconds": Of("sum", "time_in_fault_s"),
        "downtime_seconds": Of("sum", _DOWN),
        "downtime_pct": Ratio(_DOWN, f"time_in_run_s + {_DOWN}", 100),
    },
)
RISK = MetricView(
    "mv_machine_risk",
    dict(DOWNTIME.dimensions),
    {
        "avg_anomaly_score": Of("avg", "anomaly_score"),
        **_averages({f"avg_{name}": column for name, column in _RISKS.items()}),
        "high_risk_windows": Of("count_if", "prob_fault_next_5m >= 0.5"),
        "anomaly_windows": Of("count_if", "is_anomaly"),
    },
)
_STATUS_DIMENSIONS = {
    "machine": "machine_id",
    "state": "state",
    "last_event_time": "last_event_time",
}
FRESHNESS = MetricView(
    "mv_machine_freshness",
    _STATUS_DIMENSIONS,
    {
        f"{how}_{lag}": Of(how, lag)
        for how in ("avg", "max")
        for lag in ("telemetry_lag_seconds", "ml_lag_seconds", "telemetry_lag_ms", "ml_lag_ms")
    },
)
CURRENT = MetricView(
    "mv_machine_current",
    _STATUS_DIMENSIONS,
    _averages(
        {
            "current_temp_c": "temp_c",
            "current_vibration_mm_s": "vibration_mm_s",
            "current_throughput_cpm": "throughput_cpm",
            "current_load_pct": "load_pct",
            "current_oee_pct": "oee_pct",
            **{f"current_{name}": column for name, column in _RISKS.items()},
            "current_anomaly_score": "anomaly_score",
            "current_power_kw": "power_kw",
            "current_pressure_bar": "pressure_bar",
            "current_flow_lpm": "flow_rate_lpm",
        }
    ),
)


def latency_view(hub: str = "hub", store: str = "bronze") -> MetricView:
    """Measures of the latency view with a site's own hop names."""
    names = {"d2h": f"device_to_{hub}_ms", "h2b": f"{hub}_to_{store}_ms", "total": "total_ms"}
    columns = hop_columns(hub, store)
    measures = {"record_count": COUNT}
    measures |= {f"{how}_{names[k]}": Of(how, c) for how in ("avg", "min", "max") for k, c in columns.items()}
    measures |= {f"p{round(q * 100)}_{names[k]}": Percentile(c, q) for q in (0.5, 0.95, 0.99) for k, c in columns.items()}
    dimensions = {
        "machine": "machine_id",
        "line": "line_name",
        "state": "state",
        "device_time": "device_ts",
        **_time_dimensions("device_ts", "device"),
    }
    return MetricView("mv_hop_latency", dimensions, measures)


LATENCY = latency_view()
METRIC_VIEWS = {
    v.name: v for v in (TELEMETRY, OEE, DOWNTIME, RISK, FRESHNESS, CURRENT, LATENCY)
}
# Named measures and filters offered to every report.
SAVED_MEASURES = {
    "total_downtime_s": f"sum({_DOWN})",
    "avg_oee": "round(avg(oee_pct), 1)",
    "fleet_risk": "round(avg(prob_fault_next_5m), 3)",
    "machine_count": "count(distinct machine_id)",
}
