"""Named queries: one per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import fixture, ops
from fleetlens.catalog.frames import TIE, Frames, tidy
from fleetlens.functions import bands
from fleetlens.functions.expr import as_number, before, instant, rows_since
from fleetlens.functions.scores import HORIZONS, horizon_expand, rule_flag
from fleetlens.ml import fault_model, isolation_forest
from fleetlens.ml.isolation_forest import IsolationForest, IsolationForestModel
from fleetlens.ml.scoring_log import ScoringLog, score_new
from fleetlens.ml.store import ModelStore
from fleetlens.operators import gold, labels, latest, metrics, percentiles, quality, scoring
from fleetlens.operators.partials import Partials, rank_error
from fleetlens.operators.silver import silver_clean
from fleetlens.plans import reports, requests, semantic
from fleetlens.schemas import FAULT_PREDICTIONS, SILVER, align_schema
from fleetlens.session import stored
from fleetlens.sinks.jdbc import bulk_load, mirror_counts, upsert_jdbc, valid_mirror_rows
from fleetlens.sinks import layout
from fleetlens.sinks.keyed import KeyedTable, append, export_training, publish_scores
from fleetlens.sinks.retry import FolderSink
from fleetlens.sources import bronze, serial
from fleetlens.streaming import feed, jobs

_QUERIES: dict[str, Callable[[Frames], DataFrame]] = {}


def query(fn: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
    """Register under the function's name; a trailing underscore only avoids a clash."""
    _QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def add(name: str, fn: Callable[[Frames], DataFrame]) -> None:
    _QUERIES[name] = fn


# ---- sources and ingestion ------------------------------------------------------------------


@query
def bronze_parse_json(f):
    """``raw_body`` is the message itself: its fields, read again, must be those of the row."""
    parsed = bronze.parse_bronze(f.raw, F.col("ingested"), TIE)
    return parsed.withColumn("raw_body", F.get_json_object("raw_body", "$.machine_id"))


@query
def bronze_malformed(f):
    return bronze.message_counters(fixture.raw_messages(f.fx, break_every=17))


@query
def bronze_split(f):
    good, bad = bronze.split_malformed(fixture.raw_messages(f.fx, break_every=17))
    tagged = [df.select("event_id", F.lit(part).alias("part")) for df, part in ((good, "good"), (bad, "bad"))]
    return tagged[0].unionByName(tagged[1])


@query
def bronze_enqueue_enrich(f):
    parsed = bronze.parse_bronze(f.raw, F.col("ingested"), TIE)
    return parsed.select("event_id", "ts", "iothub_enqueued_time", "ingest_ts")


def _serial_lines(f: Frames) -> DataFrame:
    fields = [F.col(c).cast("string") for c in ("vibration_mm_s", "temp_c", "throughput_cpm")]
    whole = F.concat_ws(",", *fields, "state", F.coalesce("fault_code", F.lit("NONE")))
    short = F.concat_ws(",", *fields, "state")
    broken = F.concat_ws(",", F.lit("x"), *fields[1:], "state", F.lit(""))
    line = F.when(F.col("event_id") % 41 == 0, short).when(F.col("event_id") % 43 == 0, broken)
    return f.fx.select("event_id", line.otherwise(whole).alias("line"))


@query
def serial_csv_parse(f):
    good, _ = serial.parse_serial_csv(_serial_lines(f), keep=TIE)
    return good


@query
def serial_csv_rejects(f):
    _, rejects = serial.parse_serial_csv(_serial_lines(f), keep=TIE)
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("lines"))


@query
def derive_metrics(f):
    good, _ = serial.parse_serial_csv(_serial_lines(f), keep=TIE)
    return serial.derive_metrics(good).drop("fault_code", "state")


@query
def derive_metrics_measured(f):
    measured = f.fx.select(*TIE, "throughput_cpm", "temp_c", "rpm", "current_amps", "humidity_pct")
    return serial.derive_metrics(measured)


@query
def src_batch_table(f):
    return f.silver.select("machine_id", "event_time", *scoring.FEATURES, "state")


@query
def schema_evolve(f):
    older = f.silver.select("event_time", "machine_id", "temp_c", F.col("state").alias("STATE"))
    return align_schema(older, SILVER).select("event_time", "machine_id", "temp_c", "state", "rpm", "ingest_ts")


@query
def optional_cols(f):
    older = f.fault.select("machine_id", "event_time", "prob_fault_next_5m", "predicted_fault_next_5m", *TIE)
    return align_schema(older, FAULT_PREDICTIONS, keep_extra=True)


# ---- projections, filters, predicates -------------------------------------------------------


@query
def silver_clean_(f):
    return silver_clean(f.bronze_text, TIE)


@query
def dq_expectations(f):
    return quality.count_violations(f.silver)


@query
def dq_flag_rows(f):
    names = F.array_join(F.array_sort("violated_rules"), ",")
    return quality.flag_rows(f.silver).select(*TIE, names.alias("violated"))


@query
def hop_latency_silver(f):
    return f.silver.select(*TIE, "device_to_hub_ms", "hub_to_bridge_ms")


@query
def hop_latency_events(f):
    return semantic.hop_latency(f.bronze_text)


@query
def telemetry_live(f):
    return semantic.telemetry_live(f.silver, f.as_of)


@query
def telemetry_live_2h(f):
    return semantic.telemetry_live(f.silver, f.as_of, 2, semantic.LIVE_COLUMNS_SHORT)


@query
def telemetry_between(f):
    hour = 3_600_000_000
    live = semantic.telemetry_live(f.silver, f.as_of)
    found = semantic.telemetry_between(live, f.as_of - 2 * hour, f.as_of - hour)
    return found.select("event_time", "event_hour", "machine_id", "state", *scoring.FEATURES)


@query
def dim_machine(f):
    return semantic.dim_machine(f.silver)


def _banded(f: Frames, **columns) -> DataFrame:
    return f.status.select("machine_id", *[c.alias(n) for n, c in columns.items()])


@query
def risk_band(f):
    return _banded(f, risk_band=bands.risk_band(F.col("prob_fault_next_5m")))


@query
def maintenance_band(f):
    risks = [F.col(f"prob_fault_next_{h}") for h in ("5m", "24h", "7d")]
    return _banded(f, maintenance_band=bands.maintenance_band(*risks))


@query
def latency_status(f):
    return f.latency.select(
        "machine_id",
        "device_ts",
        "total_device_to_bronze_ms",
        bands.latency_status(F.col("total_device_to_bronze_ms")).alias("latency_status"),
    )


@query
def sensor_status(f):
    return f.silver.select(*TIE, *[bands.sensor_status(c).alias(f"{c}_status") for c in bands.SENSOR_LIMITS])


@query
def vibration_status(f):
    return f.silver.select(*TIE, bands.vibration_status(F.col("vibration_mm_s")).alias("vibration_status"))


@query
def sensor_bands(f):
    labelled = [bands.sensor_band(c).alias(f"{c}_band") for c in bands.SENSOR_BANDS]
    needles = [bands.gauge_fraction(c).alias(f"{c}_gauge") for c in bands.GAUGES]
    return f.silver.select(*TIE, *labelled, *needles)


@query
def freshness_band(f):
    age = F.col("telemetry_lag_seconds")
    return _banded(f, freshness=bands.freshness_band(age), age=bands.age_label(age))


@query
def kpi_bands(f):
    averages = f.status.agg(F.avg("oee_pct").alias("oee"), F.avg("prob_fault_next_5m").alias("risk"))
    hop = f.latency.groupBy("machine_id").agg(F.avg("total_device_to_bronze_ms").alias("ms"))
    fleet = averages.select(F.lit("fleet").alias("scope"), bands.oee_band(F.col("oee")).alias("first"), bands.average_risk_band(F.col("risk")).alias("second"))
    hops = hop.select(F.col("machine_id").alias("scope"), bands.hop_band(F.col("ms")).alias("first"), F.lit(None).cast("string").alias("second"))
    return fleet.unionByName(hops)


@query
def threshold_crossed(f):
    return f.silver.select(*TIE, labels.threshold_crossed().alias("threshold_crossed"))


@query
def fault_classify(f):
    manual = F.col("fault_code") == "BEARING_WEAR"
    return f.silver.where(labels.is_fault()).select(
        *TIE, labels.fault_classify().alias("cause"), labels.fault_classify(manual=manual).alias("cause_manual")
    )


@query
def rule_flag_(f):
    return f.silver.select(*TIE, rule_flag().alias("rule_flag"))


@query
def rule_alerts(f):
    return scoring.rule_alerts(f.silver, f.as_of)


@query
def param_in_filters(f):
    chosen = reports.in_lists(
        f.latency, machine_id=(), state=("RUN", "FAULT"), line_name=("Physical Line 0000", "Virtual Line 0004")
    )
    return chosen.select("machine_id", "line_name", "state", "device_ts")


@query
def machine_id_valid(f):
    return reports.valid_machine_ids(f.fx.where("machine_id is not null"))


@query
def localize_ts(f):
    return reports.localize(f.silver.select(*TIE, "event_time"), ["event_time"])


@query
def drop_incomplete(f):
    return scoring.drop_incomplete(f.fx, ["machine_id", *scoring.FEATURES]).select(*TIE, "machine_id")


def _mirror_input(f: Frames) -> DataFrame:
    return f.fx.select(
        F.col("machine_id"), F.timestamp_millis("device_ms").alias("last_event_time"), *TIE
    )


@query
def valid_mirror_rows_(f):
    return valid_mirror_rows(_mirror_input(f))


@query
def valid_mirror_counts(f):
    return mirror_counts(_mirror_input(f))


@query
def live_lag(f):
    return f.status.select("machine_id", "telemetry_lag_ms", "live_telemetry_lag_ms")


@query
def saved_filters(f):
    tests = reports.saved_filters(f.as_of)
    joined = f.status.withColumn("event_time", F.col("last_event_time"))
    return joined.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


# ---- joins ----------------------------------------------------------------------------------


@query
def machine_health(f):
    return f.health


@query
def machine_health_v0(f):
    return semantic.machine_health(f.gold, f.anomaly, f.fault, order=("event_time",), tiebreak=TIE).select(
        "machine_id", "window_start", "window_end", "oee_pct", "anomaly_score", "is_anomaly",
        "prob_fault_next_5m", "predicted_fault_next_5m",
    )


@query
def current_status(f):
    return f.status


@query
def latency_with_line(f):
    return f.latency.select("machine_id", "line_name", "state", "total_device_to_bronze_ms")


@query
def drilldown(f):
    return reports.drilldown(f.status)


@query
def oee_by_line(f):
    return reports.oee_by_machine(f.status, f.dim, digits=None).drop("state")


@query
def gold_vs_mirror_delta(f):
    return reports.mirror_delta(f.latest, f.mirror)


@query
def enrich_live(f):
    return reports.enrich_live(f.mirror.drop("telemetry_lag_ms", "telemetry_lag_seconds"), f.status, f.as_of)


@query
def changed_since_mirror(f):
    columns = ["machine_id", "last_event_time", "state"]
    return latest.changed_rows(f.mirror.select(*columns), f.latest.select(*columns), ["machine_id"])


# ---- aggregations ---------------------------------------------------------------------------


@query
def gold_health_window(f):
    return gold.health_windows(f.silver)


@query
def gold_health_window_1m(f):
    return gold.oee(gold.health_windows(f.silver, "1 minute"), target_cpm=80, window_seconds=60)


@query
def gold_oee(f):
    columns = [c for c in gold.HEALTH_COLUMNS if c not in ("anomaly_score", "is_anomaly", "rule_based_risk_score")]
    return f.gold.select(*columns)


@query
def gold_oee_from_messages(f):
    """The whole path: message text, bronze, silver, windows, OEE."""
    parsed = bronze.parse_bronze(f.raw, F.col("ingested"))
    windows = gold.machine_health_windows(silver_clean(parsed))
    columns = [c for c in gold.HEALTH_COLUMNS if c not in ("anomaly_score", "is_anomaly", "rule_based_risk_score")]
    return windows.select(*columns)


@query
def gold_anomaly_rule(f):
    return f.gold.select("machine_id", "window_start", "anomaly_score", "is_anomaly")


@query
def gold_risk_rule(f):
    return f.gold.select("machine_id", "window_start", "rule_based_risk_score")


@query
def status_window_10s(f):
    return f.status10


@query
def mv_machine_telemetry(f):
    return metrics.TELEMETRY.query(f.silver, by=["machine", "state", "event_hour"])


@query
def mv_machine_oee(f):
    return metrics.OEE.query(f.gold, by=["machine", "window_hour"])


@query
def mv_machine_downtime(f):
    return metrics.DOWNTIME.query(f.gold, by=["machine", "window_date"])


@query
def mv_machine_risk(f):
    return metrics.RISK.query(f.health, by=["machine", "window_date"])


@query
def mv_machine_freshness(f):
    return metrics.FRESHNESS.query(f.status, by=["machine", "state"])


@query
def mv_machine_current(f):
    return metrics.CURRENT.query(f.status, by=["state"])


@query
def mv_hop_latency(f):
    return metrics.LATENCY.query(f.latency, by=["line", "state", "device_hour"])


@query
def mv_hop_latency_total(f):
    return metrics.LATENCY.query(f.latency)


@query
def measure_query_freshness(f):
    names = ["avg_telemetry_lag_ms", "avg_ml_lag_ms", "max_telemetry_lag_ms", "max_ml_lag_ms"]
    return metrics.FRESHNESS.query(f.status, names, ["machine"])


@query
def measure_query_oee_hour(f):
    return metrics.OEE.query(f.gold, by=["window_hour"])


@query
def measure_query_risk_day(f):
    names = [f"avg_fault_risk_{h}" for h in ("5m", "1h", "24h", "7d")] + ["high_risk_windows"]
    return metrics.RISK.query(f.health, names, ["window_date"], where="window_end is not null")


TELEMETRY_PARTIALS = Partials(metrics.TELEMETRY, ("machine_id", "state"), "event_time")
LATENCY_PARTIALS = Partials(metrics.LATENCY, ("machine_id", "line_name", "state"), "device_ts")
RISK_PARTIALS = Partials(metrics.RISK, ("machine_id",), "window_end")


@query
def partials_telemetry(f):
    """The hourly telemetry measures out of stored five-minute partials."""
    kept = stored(TELEMETRY_PARTIALS.build(f.silver))
    return TELEMETRY_PARTIALS.query(kept, by=["machine", "state", "event_hour"])


@query
def partials_telemetry_stream(f):
    """The same, kept up to date by a stream: all buckets that the watermark has closed."""
    work = f.work_dir()
    jobs.start_partials(f.silver_stream, TELEMETRY_PARTIALS, f"{work}/out", f"{work}/cp").awaitTermination()
    return TELEMETRY_PARTIALS.query(f.spark.read.parquet(f"{work}/out"), by=["state", "event_hour"])


@query
def partials_risk(f):
    return RISK_PARTIALS.query(stored(RISK_PARTIALS.build(f.health)), by=["machine", "window_date"])


@query
def partials_hop_latency(f):
    """Counts, averages and extremes of the hops by hour, merged from partials."""
    kept = stored(LATENCY_PARTIALS.build(f.latency))
    names = [n for n in metrics.LATENCY.measures if not n.startswith("p")]
    return LATENCY_PARTIALS.query(kept, names, by=["line", "state", "device_hour"])


@query
def partials_sketch_checks(f):
    """Percentiles of sketches merged over the fleet whose rank is off by more than the stated error (none may)."""
    hops = stored(f.latency.select("machine_id", "line_name", "state", "device_ts", *metrics.hop_columns().values()))
    names = {n: m for n, m in metrics.LATENCY.measures.items() if isinstance(m, metrics.Percentile)}
    found = LATENCY_PARTIALS.query(stored(LATENCY_PARTIALS.build(hops)), list(names)).first()
    error = rank_error(LATENCY_PARTIALS.k)
    off = []
    for name, m in names.items():
        below, upto = F.avg(as_number(F.col(m.column) < found[name])), F.avg(as_number(F.col(m.column) <= found[name]))
        off.append(as_number((below > m.q + error) | (upto < m.q - error)))
    return hops.agg(F.count(F.lit(1)).alias("record_count"), reduce(Column.__add__, off).cast("bigint").alias("outside"))


add("fleet_kpis", lambda f: reports.fleet_kpis(f.status))
add("fleet_summary", lambda f: reports.fleet_summary(f.status))
add("downtime_by_line", lambda f: reports.downtime_by_line(f.health, None, f.as_of))
add("downtime_by_machine", lambda f: reports.downtime_by_machine(f.health, f.as_of))
add("latency_by_machine", lambda f: reports.latency_by_machine(f.silver, f.as_of))
add("latency_stats", lambda f: reports.latency_stats(f.latency, f.as_of, minutes=30, states=("RUN", "FAULT")))
add(
    "fleet_latency_rollup",
    lambda f: reports.fleet_latency_rollup(reports.latency_stats(f.latency, f.as_of, minutes=60)),
)
add("hop_breakdown", lambda f: reports.hop_breakdown(f.latency, f.as_of))
add("gold_lag_summary", lambda f: reports.gold_lag_summary(f.latest))
add("bronze_recent", lambda f: reports.bronze_recent(f.bronze_text, f.as_of))
add("freshness_summary", lambda f: reports.freshness_summary(f.status, f.as_of))
add("latency_percentiles_approx", lambda f: reports.lag_percentiles_approx(f.status))
add("risk_mix", lambda f: reports.risk_mix(f.status, f.as_of))
add("fault_mix", lambda f: reports.fault_mix(f.silver, f.as_of))
add("risk_cards", lambda f: reports.risk_cards(f.status))
add("explorer_kpis", lambda f: reports.explorer_kpis(f.status, state=("RUN", "FAULT")))
add("status_summary", lambda f: reports.status_summary(f.status))
add("sr_status_counts", lambda f: requests.sr_status_counts(f.requests))
add("saved_measures", lambda f: reports.saved_measures(f.health))
add("machine_summary_lines", lambda f: reports.summary_lines(f.status))


@query
def score_stats(f):
    both = scoring.score_windows(f.silver, f.as_of, batch_hours=2)
    raw = (F.lit(60.0) - F.col("temp_c")) / F.lit(40.0)
    scored = scoring.anomaly_rows(both.withColumn("raw", raw), "fixture", instant(f.as_of))
    return scoring.anomaly_stats(scored)


add("prediction_stats", lambda f: scoring.prediction_stats(f.fault))


@query
def probe_stats(f):
    lag = F.unix_millis("ingest_ts") - F.unix_millis("event_time")
    return percentiles.probe_stats(f.silver.select("machine_id", lag.alias("lag_ms")), ["machine_id"])


# ---- window functions -----------------------------------------------------------------------


@query
def latest_by_key(f):
    return latest.latest_by_key(f.silver, ["machine_id"], ["event_time"], TIE)


@query
def latest_scores(f):
    return scoring.latest_scores(f.anomaly, TIE)


@query
def label_future_fault(f):
    return labels.label_future_fault(f.silver, 300).select(*TIE, "label_fault_next_5m")


@query
def label_future_fault_20s(f):
    return labels.label_future_fault(f.silver, 20, "label_20s").select(*TIE, "label_20s")


@query
def label_next_rows(f):
    rows = f.silver.select("machine_id", "event_time", "state", "fault_code", *TIE)
    return labels.label_next_rows(rows, 3, ["event_time", *TIE]).select(*TIE, "label_fault_next_5m")


def _polls(f: Frames) -> DataFrame:
    """What a 10 s poll of every machine sees: the newest event so far, known 10 s at least."""
    ten = 10_000_000
    due = F.timestamp_micros(F.floor(F.unix_micros("event_time") / ten) * ten + ten)
    seen = f.silver.groupBy("machine_id", due.alias("poll_time")).agg(F.max("event_time").alias("seen_time"))
    again = F.array(F.col("poll_time"), F.timestamp_micros(F.unix_micros("poll_time") + 1))
    # Every poll is repeated at once, so half of them show no change.
    return seen.select("machine_id", F.explode(again).alias("poll_time"), "seen_time")


@query
def change_points(f):
    return labels.change_points(_polls(f), "machine_id", "poll_time", "seen_time")


# ---- sorts, limits, top-k -------------------------------------------------------------------

add("metric_summary", lambda f: reports.metric_summary(f.status))
add("flow_break_signals", lambda f: reports.flow_break_signals(f.status))
add("top_risk_25", lambda f: reports.top_n(f.status.select("machine_id", "state", "prob_fault_next_5m"), ["-prob_fault_next_5m"], 25, ["machine_id"]))
add("risk_ranking", lambda f: reports.risk_ranking(f.status))
add("top_fault_risk", lambda f: reports.top_fault_risk(f.status))
add("top_fault_risk_5", lambda f: reports.top_fault_risk(f.status, 5))
add("lag_ranking", lambda f: reports.lag_ranking(f.status))
add("recent_status", lambda f: reports.recent_status(f.mirror))
add("fleet_freshness_recent", lambda f: reports.fleet_freshness_recent(f.status, f.as_of))
add("oee_ascending", lambda f: reports.oee_by_machine(f.status, f.dim))
add("oee_by_window", lambda f: reports.oee_by_window(f.health, f.as_of - 7_200_000_000, f.as_of))
add("sr_list", lambda f: requests.sr_list(f.requests, ["OPEN", "IN_PROGRESS"], ["CRITICAL", "HIGH"]))
add("sr_total", lambda f: requests.sr_total(f.requests, statuses=["OPEN", "IN_PROGRESS"], priorities=["CRITICAL", "HIGH"]))


@query
def sr_sort_priority(f):
    return requests.sr_sorted(f.requests, "priority").select("id", "priority", "status")

@query
def machine_point_lookup(f):
    return reports.machine_risks(f.status, "MC-0000")


@query
def machine_trend(f):
    live = semantic.telemetry_live(f.silver, f.as_of, 1)
    shown = {"vibration": ("vibration_mm_s", 2), "temp": ("temp_c", 2), "amps": ("current_amps", 2)}
    one = live.where(F.col("machine_id") == "MC-0000")
    return one.select("event_time", "machine_id", *reports.rounded(one, shown), "rpm", "state")


add("over_threshold_anomaly", lambda f: reports.over_threshold(f.status, "anomaly_score", 0.7))
add("over_threshold_vibration", lambda f: reports.over_threshold(f.status, "vibration_mm_s", 8))


@query
def fleet_answers(f):
    return f.status.agg(
        F.count_if(F.col("state") == "RUN").alias("running_machines"),
        F.round(F.avg("oee_pct"), 1).alias("avg_oee_pct"),
        F.round(F.avg("telemetry_lag_ms"), 0).alias("avg_lag_ms"),
        F.max("telemetry_lag_ms").alias("max_lag_ms"),
    )


add("latest_oee", lambda f: reports.oee_by_machine(f.status, digits=None).drop("state"))
add("fleet_status", lambda f: reports.fleet_status(f.status))

# ---- set operations -------------------------------------------------------------------------


@query
def score_modes_union(f):
    both = scoring.score_windows(f.silver, f.as_of, batch_hours=2)
    return both.select(*TIE, "machine_id", "event_time", "inference_type", rule_flag().alias("rule_flag"))


# ---- scoring without a model ----------------------------------------------------------------


@query
def blend_score(f):
    scored = scoring.blend_score(f.scorable)
    return scored.select(*TIE, "rule_flag", "anomaly_score", "is_anomaly")


@query
def horizon_expand_(f):
    shares = horizon_expand(F.col("humidity_pct") / F.lit(7100.0))
    return f.silver.select(*TIE, *[p.alias(f"p_{label}") for label, p in shares.items()])


add("fault_predictions", lambda f: f.fault)


@query
def score_windows(f):
    both = scoring.score_windows(scoring.drop_incomplete(f.silver), f.as_of, batch_hours=1)
    return both.groupBy("inference_type", "machine_id").agg(F.count(F.lit(1)).alias("events"))


@query
def training_export(f):
    rows = labels.training_rows(f.silver).drop("ingest_ts", "enqueued_time", "iothub_device_id")
    targets = export_training(rows, f.work_dir())
    readers = {
        "parquet": f.spark.read,
        "json": f.spark.read.schema(rows.schema),
        "csv": f.spark.read.schema(rows.schema).option("header", True),
    }
    return reduce(
        DataFrame.unionByName,
        [reader.format(kind).load(targets[kind]).withColumn("format", F.lit(kind)) for kind, reader in readers.items()],
    )


add("last_scored_ts", lambda f: scoring.last_scored(f.anomaly))

# ---- sinks, mirror, checks ------------------------------------------------------------------


@query
def upsert_parquet(f):
    table = KeyedTable(f.spark, f.work_dir(), ("machine_id",), ("last_event_time",))
    columns = ["machine_id", "last_event_time", "state", "temp_c", "rpm"]
    table.upsert(f.mirror.select(*columns), "old")
    table.upsert(f.latest.select(*columns), "new")
    table.upsert(f.mirror.select(*columns), "older again")
    return table.read()


@query
def sink_append(f):
    """Alerts appended in two loads."""
    path, alerts = f.work_dir(), scoring.rule_alerts(f.silver, f.as_of)
    append(alerts.where("rpm < 2300"), path)
    append(alerts.where("rpm >= 2300"), path)
    return f.spark.read.parquet(path)


@query
def sr_bulk_load(f):
    path = f.work_dir()
    bulk_load(f.requests, path, append, writers=4)
    loaded = f.spark.read.parquet(path)
    return loaded.groupBy("status", "priority", "request_type").agg(F.count(F.lit(1)).alias("requests"))


@query
def validate_outputs(f):
    tables = {"bronze": f.bronze, "silver": f.silver, "gold": f.gold, "anomaly": f.anomaly, "fault": f.fault}
    found = ops.validate_outputs(tables, ["bronze", "silver", "anomaly", "fault"], ["gold"])
    assert not found["warnings"]
    return f.spark.createDataFrame(sorted(found["counts"].items()), "table_name string, row_count bigint")


@query
def dry_run_validate(f):
    def refuse(*_):
        raise AssertionError("a dry run writes nothing")

    found = upsert_jdbc(f.status, refuse, refuse, dry_run=True)
    return f.spark.createDataFrame(
        [(found["row_count"], found["valid_rows"], found["invalid_rows"], found["source_watermark"], found["written"])],
        "row_count bigint, valid_rows bigint, invalid_rows bigint, source_watermark timestamp, written boolean",
    )


@query
def score_publish(f):
    """The published table and, per machine, the rows its history got."""
    work = f.work_dir()
    table = publish_scores(f.anomaly, f"{work}/history", f"{work}/latest", "run")
    history = f.spark.read.parquet(f"{work}/history").groupBy("machine_id").agg(F.count(F.lit(1)).alias("history_rows"))
    return table.read().join(history, "machine_id")


add("parity_check", lambda f: ops.parity_check(f.latest, f.mirror))


@query
def parity_differences(f):
    columns = ["machine_id", "last_event_time", "state", "temp_c", "rpm", "fault_code"]
    sides = [df.select(*columns) for df in (f.latest, f.mirror.where("machine_id <> 'MC-0005'"))]
    return ops.parity_differences(*sides)


@query
def view_refresh_counts(f):
    live = semantic.telemetry_live(f.silver, f.as_of)
    counts = ops.table_counts({"live_rows": live, "health_rows": f.health, "status_rows": f.status})
    # The downtime view has the rows of the health view, counted once for both.
    both = F.when(F.col("table_name") == "health_rows", F.array("table_name", F.lit("downtime_rows")))
    return counts.select(F.explode(both.otherwise(F.array("table_name"))).alias("table_name"), "row_count")


@query
def stream_health(f):
    """Records of the last hour if the check passes."""
    return f.spark.createDataFrame([(ops.stream_health(f.silver, f.as_of, minimum=1),)], "records bigint")


@query
def view_register(f):
    tables = {
        "silver_machine_telemetry": f.silver,
        "bronze_iot_telemetry": f.bronze,
        "gold_machine_health_5m": f.gold,
        "gold_machine_current_status": f.status10,
        "ml_anomaly_scores": scoring.latest_scores(f.anomaly, TIE),
        "ml_fault_predictions": scoring.latest_scores(f.fault, TIE),
    }
    semantic.register_views(tables, f.as_of)
    return f.spark.sql(
        "select s.machine_id, s.state, d.line_name, s.oee_pct, s.anomaly_score, s.prob_fault_next_24h "
        "from vw_machine_current_status s left join dim_machine d on s.machine_id = d.machine_id"
    )


@query
def sr_update_status(f):
    now = f.as_of
    changes = f.requests.where("priority = 'CRITICAL' and status = 'OPEN'").select("id", F.lit("IN_PROGRESS").alias("status"))
    table = KeyedTable(f.spark, f.work_dir(), ("id",), ("updated_at",))
    table.upsert(f.requests, "load")
    table.upsert(requests.sr_apply_status(f.requests, changes, now), "change")
    return table.read().groupBy("status", "priority").agg(
        F.count(F.lit(1)).alias("requests"), F.max("updated_at").alias("last_change")
    )


@query
def sr_create(f):
    wanted = f.status.select(
        "machine_id",
        F.lit("HIGH").alias("priority"),
        F.lit("INSPECTION").alias("request_type"),
        F.lit("check").alias("description"),
        F.lit("planner").alias("requestor"),
        F.regexp_extract("machine_id", "([0-9]+)$", 1).alias("position"),
    )
    return requests.sr_create(wanted, "b1", f.as_of)


# ---- models ---------------------------------------------------------------------------------


def _fault_model(f: Frames) -> tuple[fault_model.FaultModel, DataFrame]:
    rows = fault_model.training_rows(f.silver, f.as_of)
    return fault_model.FaultModel.fit(rows), rows


@query
def fault_train(f):
    return fault_model.describe(_fault_model(f)[0], f.spark)


@query
def fault_metrics(f):
    model, rows = _fault_model(f)
    found = model.metrics(rows)
    return rows.agg(F.count(F.lit(1)).alias("train_rows"), *[F.lit(v).alias(k) for k, v in found.items()])


@query
def fault_score(f):
    model, _ = _fault_model(f)
    segments = scoring.score_windows(scoring.drop_incomplete(f.silver), f.as_of)
    return scoring.prediction_rows(model.score(segments), model.run_id, instant(f.as_of), base_s=model.horizon_s)


@query
def fault_score_checks(f):
    """Per mode: rows, and rows that break a rule of the published probabilities (none may)."""
    p = [f"prob_fault_next_{h}" for h in HORIZONS]
    outside = reduce(or_, [F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1) for c in p])
    shrinking = reduce(or_, [F.col(a) > F.col(b) for a, b in zip(p, p[1:])])
    unlike = reduce(or_, [F.col(f"predicted_fault_next_{h}") != (F.col(f"prob_fault_next_{h}") >= 0.5) for h in HORIZONS])
    return fault_score(f).groupBy("inference_type").agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.count_if(outside).alias("outside"),
        F.count_if(shrinking).alias("shrinking"),
        F.count_if(unlike).alias("flags_unlike"),
    )


@query
def fault_metrics_checks(f):
    """Rows trained on, and whether both areas lie above chance."""
    model, rows = _fault_model(f)
    found = model.metrics(rows)
    above = F.lit(0.5 <= found["roc_auc"] <= 1 and 0 < found["avg_precision"] <= 1).alias("plausible")
    return rows.agg(F.count(F.lit(1)).alias("train_rows"), above)


@query
def anomaly_score_checks(f):
    """Per mode: rows, and rows that break a rule of the published scores (none may)."""
    score = F.col("anomaly_score")
    return anomaly_score_model(f).groupBy("inference_type").agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.count_if(score.isNull() | (score < 0) | (score > 1)).alias("outside"),
        F.count_if(F.col("is_anomaly") != (score >= 0.7)).alias("flags_unlike"),
    )


@query
def scored_health(f):
    """Train, score, publish and read the scores back in the health view, end to end."""
    work = f.work_dir()
    model, _ = _fault_model(f)
    events = scoring.drop_incomplete(f.silver, ["machine_id", "event_time"])
    risks = scoring.prediction_rows(
        model.score(events.withColumn("inference_type", F.lit("batch"))), model.run_id, instant(f.as_of), base_s=model.horizon_s
    )
    rows = isolation_forest.training_frame(f.silver, f.as_of)
    forest = IsolationForest(n_trees=50).fit(rows)
    unusual = scoring.anomaly_rows(
        forest.decision(rows.withColumn("inference_type", F.lit("batch"))), forest.run_id, instant(f.as_of)
    )
    fault = publish_scores(risks, f"{work}/fault_history", f"{work}/fault")
    anomaly = publish_scores(unusual, f"{work}/anomaly_history", f"{work}/anomaly")
    health = semantic.machine_health(f.gold, anomaly.read(), fault.read())
    history = f.spark.read.parquet(f"{work}/fault_history").groupBy("machine_id").agg(F.count(F.lit(1)).alias("scored_rows"))
    return health.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("prob_fault_next_5m").between(0, 1)).alias("with_risk"),
    ).join(history, "machine_id", "left")


@query
def fault_train_guard(f):
    store = ModelStore(f.spark, f.work_dir())
    trained = fault_model.train_or_reuse(f.silver, f.as_of, store)
    healthy = f.silver.where("state = 'RUN'").withColumn("fault_code", F.lit(None).cast("string"))
    reused = fault_model.train_or_reuse(healthy, f.as_of, store)
    same = F.lit(reused.run_id == trained.run_id).alias("reused_last_model")
    return f.silver.agg(F.count(F.lit(1)).alias("rows"), same)


@query
def anomaly_train(f):
    model = IsolationForest().fit(isolation_forest.training_frame(f.silver, f.as_of))
    return f.spark.createDataFrame(model.nodes, isolation_forest.NODES)


@query
def anomaly_score_model(f):
    rows = isolation_forest.training_frame(f.silver, f.as_of)
    model = IsolationForest().fit(rows)
    segments = scoring.score_windows(rows, f.as_of)
    return scoring.anomaly_rows(model.decision(segments), model.run_id, instant(f.as_of))


@query
def anomaly_cut_checks(f):
    """Rows trained on, and whether as many lie below the cut as the contamination says (ties may take some)."""
    rows = isolation_forest.training_frame(f.silver, f.as_of)
    forest = IsolationForest(n_trees=50)
    decided = stored(forest.fit(rows).decision(rows).select("raw"))
    n, below, upto = decided.agg(F.count("raw"), F.count_if(F.col("raw") < 0), F.count_if(F.col("raw") <= 0)).first()
    exact = below <= int(n * forest.contamination) < upto
    return f.spark.createDataFrame([(n, exact)], "train_rows bigint, exact_share boolean")


@query
def model_registry_lookup(f):
    store = ModelStore(f.spark, f.work_dir())
    # Two models are trained on the rows and one scores them.
    rows = stored(isolation_forest.training_frame(f.silver, f.as_of).select(*TIE, *isolation_forest.FEATURES))
    first = IsolationForest(n_trees=20).fit(rows).save(store)
    second = IsolationForest(n_trees=20, seed=7).fit(rows).save(store)
    found = IsolationForestModel.load_latest(store)
    newest = found.run_id == max(first.run_id, second.run_id)
    return found.decision(rows).agg(
        F.lit(newest).alias("newest_found"), F.count(F.lit(1)).alias("rows_scored")
    )


# ---- streams --------------------------------------------------------------------------------


def _finish(query, path: str, f: Frames) -> DataFrame:
    query.awaitTermination()
    return f.spark.read.parquet(path)


@query
def src_stream_table(f):
    work = f.work_dir()
    done = jobs.append_files(
        fixture.telemetry(f.event_stream), f"{work}/out", f"{work}/cp", jobs.AVAILABLE_NOW
    )
    return _finish(done, f"{work}/out", f).select(*TIE, "machine_id", "state", "enqueued_ms")


@query
def stream_bridge(f):
    work = f.work_dir()
    raw = fixture.raw_messages(fixture.telemetry(f.event_stream))
    done = jobs.start_bronze(
        raw, f"{work}/out", f"{work}/cp", ingest_time=F.col("ingested"), keep=TIE
    )
    return _finish(done, f"{work}/out", f).drop("raw_body")


@query
def stream_silver(f):
    work = f.work_dir()
    source = fixture.bronze(fixture.telemetry(f.event_stream))
    done = jobs.start_silver(source, f"{work}/out", f"{work}/cp", keep=TIE)
    return _finish(done, f"{work}/out", f).drop("event_date")


@query
def stored_silver_lookback(f):
    """The last hour out of silver as the stream stores it, by date: older dates are not read."""
    work = f.work_dir()
    done = jobs.start_silver(fixture.bronze(fixture.telemetry(f.event_stream)), f"{work}/out", f"{work}/cp", keep=TIE)
    stored_rows = _finish(done, f"{work}/out", f)
    return rows_since(stored_rows, "event_time", before(f.as_of, minutes=60)).drop("event_date")


@query
def stored_machine_lookup(f):
    """One machine's last hours out of stored silver: some dates settled, the rest as the stream wrote them."""
    work = f.work_dir()
    live, settled = f"{work}/out", f"{work}/settled"
    jobs.start_silver(fixture.bronze(fixture.telemetry(f.event_stream)), live, f"{work}/cp", keep=TIE).awaitTermination()
    newest = f.spark.read.parquet(live).agg(F.max(layout.DATE)).first()[0]
    layout.settle(f.spark, live, settled, layout.closed_before(newest, open_days=0))
    rows = layout.read_layout(f.spark, live, settled)
    return layout.machine_between(rows, "MC-0003", f.as_of - 7_200_000_000, f.as_of).drop(layout.DATE)


@query
def stream_gold_health(f):
    work = f.work_dir()
    done = jobs.start_health(f.silver_stream, f"{work}/out", f"{work}/cp")
    return _finish(done, f"{work}/out", f)


@query
def stream_late_data(f):
    """Rows sent again hours late must not change the windows already published."""
    work = f.work_dir()
    append(f.silver, f"{work}/in")
    source = jobs.stream_table(f.spark, f"{work}/in", f.silver.schema)
    jobs.start_health(source, f"{work}/out", f"{work}/cp").awaitTermination()
    hours_old = F.unix_micros("event_time") <= f.as_of - 2 * 3_600_000_000
    append(f.silver.where(hours_old), f"{work}/in")
    return _finish(jobs.start_health(source, f"{work}/out", f"{work}/cp"), f"{work}/out", f)


@query
def stream_late_rows(f):
    """Per machine: rows sent, on time and late, and rows of its corrected telemetry partials."""
    work = f.work_dir()
    append(f.silver, f"{work}/in")
    source = jobs.stream_table(f.spark, f"{work}/in", f.silver.schema)
    jobs.start_routed(source, f"{work}/out", f"{work}/cp").awaitTermination()
    hours_old = F.unix_micros("event_time") <= f.as_of - 2 * 3_600_000_000
    append(f.silver.where(hours_old), f"{work}/in")
    routed = _finish(jobs.start_routed(source, f"{work}/out", f"{work}/cp"), f"{work}/out", f)
    on_time, late = routed.where("late = 0"), routed.where("late = 1")
    parts = TELEMETRY_PARTIALS.build(on_time).unionByName(TELEMETRY_PARTIALS.build(late))
    counted = TELEMETRY_PARTIALS.query(parts, ["event_count"], ["machine"]).withColumnRenamed("machine", "machine_id")
    sides = routed.groupBy("machine_id").agg(
        F.count_if(F.col("late") == 0).alias("on_time"), F.sum("late").alias("late")
    )
    return sides.join(counted, "machine_id")


@query
def stream_status_10s(f):
    work = f.work_dir()
    done = jobs.start_status(f.silver_stream, f"{work}/out", f"{work}/cp", tiebreak=TIE, as_of=f.as_of)
    return _finish(done, f"{work}/out", f)


@query
def stream_latest_scd1(f):
    work = f.work_dir()
    columns = ["machine_id", "event_time", "state", "temp_c", "rpm", *TIE]
    readings = f.silver_stream.select(*columns).withColumnRenamed("event_time", "last_event_time")
    readings = gold.with_lag(readings, f.as_of)
    jobs.start_latest(readings, f"{work}/out", f"{work}/cp", tiebreak=TIE).awaitTermination()
    return KeyedTable(f.spark, f"{work}/out", ("machine_id",), ("last_event_time",)).read()


@query
def stream_change_feed(f):
    """The table a change feed leads to, after two deliveries, with the number of changes and inserts."""
    work = f.work_dir()
    columns = ["machine_id", "event_time", "state", "temp_c", "rpm", *TIE]
    readings = f.silver.select(*columns).withColumnRenamed("event_time", "last_event_time")
    for part in (0, 1):
        append(readings.where(F.col("event_id") % 2 == part), f"{work}/in")
        source = jobs.stream_table(f.spark, f"{work}/in", readings.schema)
        done = feed.start_change_feed(source, f"{work}/out", f"{work}/cp", tiebreak="event_id")
        changes = _finish(done, f"{work}/out", f)
    counted = changes.groupBy("machine_id").agg(
        F.max("version").alias("version"), F.count_if(F.col("change") == "insert").alias("inserts")
    )
    return feed.apply_feed(changes).join(counted, "machine_id")


@query
def sink_retry_batch(f):
    """Alerts to a folder outside Spark's writers: a token and a file per partition."""
    work = f.work_dir()
    alerts = scoring.rule_alerts(f.silver_stream, instant(f.as_of))
    jobs.start_to_sink(alerts, FolderSink(f"{work}/out"), f"{work}/cp", "event_time", 4).awaitTermination()
    return f.spark.read.schema(alerts.schema).parquet(f"{work}/out")


@query
def score_incremental(f):
    """Scores of two runs an hour apart, the second repeated: rows and scores per mode."""
    log, rows = ScoringLog(f.spark, f.work_dir()), isolation_forest.training_frame(f.silver, f.as_of)
    model = IsolationForest(n_trees=20).fit(rows)
    earlier = f.as_of - 3_600_000_000
    known = rows.where(F.unix_micros("event_time") <= earlier)
    score_new(known, model, log, earlier, "first", batch_hours=2, keep=TIE)
    for _ in range(2):
        score_new(rows, model, log, f.as_of, "second", batch_hours=2, realtime_minutes=90, keep=TIE)
    return log.read().groupBy("inference_type").agg(
        F.count(F.lit(1)).alias("rows_scored"), F.countDistinct("event_id").alias("events_scored"), F.max("event_time").alias("mark")
    )


@query
def stream_alerts(f):
    work = f.work_dir()
    done = jobs.start_alerts(
        f.silver_stream, f"{work}/out", f"{work}/cp", detected_at=instant(f.as_of)
    )
    return _finish(done, f"{work}/out", f)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: tidy(fn(Frames(spark, sf_dir)))

    return {name: bind(fn) for name, fn in _QUERIES.items()}
