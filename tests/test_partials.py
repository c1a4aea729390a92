"""Measures out of stored partial aggregates: equal to the event path, and nothing else is read."""

import random

import pytest

from fleetlens.catalog.frames import tidy
from fleetlens.operators import metrics
from fleetlens.operators.metrics import COUNT, MetricView, Of, Percentile, Ratio
from fleetlens.operators.partials import Partials, rank_error
from tests.conftest import as_set, at

VIEW = MetricView(
    "v",
    {"machine": "machine_id", "at": "t", "hour": "date_trunc('HOUR', t)", "day": "date(t)"},
    {
        "n": COUNT,
        "avg_v": Of("avg", "v"),
        "sum_v": Of("sum", "v"),
        "min_v": Of("min", "v"),
        "max_v": Of("max", "v"),
        "high": Of("count_if", "v > 500"),
        "share": Ratio("v", "w", 100),
        "p50": Percentile("v", 0.5),
        "p99": Percentile("v", 0.99),
    },
)
PARTS = Partials(VIEW, ("machine_id",), "t")
PLAIN = [n for n in VIEW.measures if not n.startswith("p")]


def events(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        machine = None if rng.random() < 0.02 else ("HOT" if rng.random() < 0.35 else f"M{rng.randrange(5)}")
        v = None if machine == "M4" or rng.random() < 0.05 else rng.randrange(1000)
        rows.append((machine, at(rng.randrange(30_000)), v, rng.choice([0, 4, None])))
    return spark.createDataFrame(rows, "machine_id string, t timestamp, v long, w int").repartition(6)


@pytest.mark.parametrize("by", [(), ("machine",), ("hour",), ("machine", "day")])
def test_any_grain_equals_the_events(spark, by):
    df = events(spark)
    parts = PARTS.build(df)
    assert parts.count() < df.count()
    assert as_set(PARTS.query(parts, PLAIN, by)) == as_set(VIEW.query(df, PLAIN, by, approx=True))


def test_partials_merge_in_any_number(spark):
    """Halves, late corrections and a merged table give the same sums; sketches keep their error."""
    df = events(spark)
    whole = PARTS.build(df)
    halves = PARTS.build(df.where("v % 2 = 0")).unionByName(PARTS.build(df.where("v % 2 = 1 or v is null")))
    want = as_set(PARTS.query(whole, PLAIN, ["machine"]))
    assert as_set(PARTS.query(halves, PLAIN, ["machine"])) == want
    merged = PARTS.merged(halves)
    assert merged.count() == whole.count() < halves.count()
    assert as_set(PARTS.query(merged, PLAIN, ["machine"])) == want


@pytest.mark.parametrize("k", [50, 200, 800])
def test_sketch_error_is_as_stated(spark, k):
    """Measured over 60,000 values and 30 merged sketches: the rank is off by less than stated."""
    rng = random.Random(k)
    values = [int(rng.lognormvariate(6, 2)) for _ in range(60_000)]
    df = spark.createDataFrame([(f"M{i % 30}", at(i % 900), v, 1) for i, v in enumerate(values)], "machine_id string, t timestamp, v long, w int")
    parts = Partials(VIEW, ("machine_id",), "t", k=k)
    found = parts.query(parts.build(df), ["p50", "p99"]).first()
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        below = sum(v < found[name] for v in values) / len(values)
        upto = sum(v <= found[name] for v in values) / len(values)
        assert below - rank_error(k) <= q <= upto + rank_error(k)


def test_nulls_and_empty(spark):
    df = events(spark)
    only_null = PARTS.query(PARTS.build(df.where("v is null")), None, ["machine"])
    row = only_null.where("machine = 'M4'").first()
    assert row["n"] > 0 and row["avg_v"] is None and row["p50"] is None and row["min_v"] is None and row["high"] == 0
    nothing = PARTS.query(PARTS.build(df.where("false"))).first()
    assert nothing["n"] == 0 and nothing["p99"] is None and nothing["share"] is None


def test_a_query_reads_partials_only(spark, tmp_path):
    df = events(spark)
    df.write.parquet(str(tmp_path / "events"))
    PARTS.build(spark.read.parquet(str(tmp_path / "events"))).write.parquet(str(tmp_path / "partials"))
    plan = PARTS.query(spark.read.parquet(str(tmp_path / "partials")), ["avg_v", "p99"], ["machine"])
    files = {f.rsplit("/", 2)[-2] for f in plan.inputFiles()}
    assert files == {"partials"}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "v__sketch" in text and "v__max" not in text.split("ReadSchema")[1]


def test_what_partials_cannot_answer(spark):
    parts = PARTS.build(events(spark, 50))
    with pytest.raises(KeyError):
        PARTS.query(parts, ["n"], ["at"])  # finer than a bucket
    with pytest.raises(KeyError):
        PARTS.query(parts, ["mean"])
    odd = MetricView("o", {"machine": "machine_id"}, {"x": "stddev(v)"})
    with pytest.raises(ValueError):
        Partials(odd, ("machine_id",), "t").build(parts)


def test_library_views_have_partials(frames):
    telemetry = Partials(metrics.TELEMETRY, ("machine_id", "state"), "event_time")
    got = telemetry.query(telemetry.build(frames.silver), by=["machine", "state", "event_date"])
    assert as_set(tidy(got)) == as_set(tidy(metrics.TELEMETRY.query(frames.silver, by=["machine", "state", "event_date"])))
    downtime = Partials(metrics.DOWNTIME, ("machine_id",), "window_end")
    got = downtime.query(downtime.build(frames.gold), by=["machine", "window_date"])
    assert as_set(tidy(got)) == as_set(tidy(metrics.DOWNTIME.query(frames.gold, by=["machine", "window_date"])))
