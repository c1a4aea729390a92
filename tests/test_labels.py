"""Labels, change points and order statistics against brute force, with a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import labels, percentiles
from fleetlens.operators.carry import bucketed
from tests.conftest import as_set, at


def machine_rows(seed=1, n=600, hot_share=0.6, span=900):
    """(machine, second, faulty, id): one machine holds most rows, seconds repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        machine = "HOT" if rng.random() < hot_share else f"M{rng.randrange(4)}"
        rows.append((machine, rng.randrange(span) + rng.random(), rng.random() < 0.05, i))
    return rows


def frame(spark, rows):
    data = [(m, at(s), "FAULT" if f else "RUN", None, i) for m, s, f, i in rows]
    return spark.createDataFrame(
        data, "machine_id string, event_time timestamp, state string, fault_code string, event_id int"
    ).repartition(5)


@pytest.mark.parametrize("horizon", [1, 7, 60, 300, 5000])
def test_future_fault_matches_brute_force(spark, horizon):
    rows = machine_rows()
    want = set()
    for m, s, _, i in rows:
        hit = any(f and m2 == m and int(s) < int(s2) <= int(s) + horizon for m2, s2, f, _ in rows)
        want.add((i, int(hit)))
    got = labels.label_future_fault(frame(spark, rows), horizon)
    assert as_set(got, "event_id", "label_fault_next_5m") == want
    assert got.columns == ["machine_id", "event_time", "state", "fault_code", "event_id", "label_fault_next_5m"]


def test_future_fault_edges(spark):
    fault_at = [0, 1, 300, 301]
    for offset, want in zip(fault_at, (0, 1, 1, 0)):
        rows = [("A", 1000.2, False, 0), ("A", 1000.9 + offset, True, 1), ("B", 1001.0, True, 2)]
        got = labels.label_future_fault(frame(spark, rows)).where("event_id = 0").first()
        assert got["label_fault_next_5m"] == want, offset


def test_future_fault_has_no_key_wide_window(spark):
    labelled = labels.label_future_fault(frame(spark, machine_rows(n=50)))
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("n", [1, 3, 50, 1000])
def test_next_rows_matches_brute_force(spark, n):
    rows = machine_rows(seed=2)
    want = set()
    for m in {r[0] for r in rows}:
        mine = sorted((s, i, f) for m2, s, f, i in rows if m2 == m)
        for k, (_, i, _) in enumerate(mine):
            want.add((i, int(any(f for _, _, f in mine[k + 1 : k + 1 + n]))))
    got = labels.label_next_rows(frame(spark, rows), n, ["event_time", "event_id"])
    assert as_set(got, "event_id", "label_fault_next_5m") == want


@pytest.mark.parametrize("bucket_s", [0.5, 7, 100, 10_000])
def test_next_rows_across_buckets(spark, bucket_s):
    """Buckets with fewer rows than ``n``, with all rows, rows without time and without machine."""
    rows = machine_rows(seed=5, n=400)
    data = [(m, at(s), "FAULT" if f else "RUN", None, i) for m, s, f, i in rows]
    data += [("HOT", None, "RUN", None, 1000), ("HOT", None, "FAULT", None, 1001), ("HOT", None, None, None, 1002)]
    data += [(None, at(k), "FAULT" if k % 9 == 0 else "RUN", None, 2000 + k) for k in range(40)]
    df = spark.createDataFrame(
        data, "machine_id string, event_time timestamp, state string, fault_code string, event_id int"
    ).repartition(5)
    want = set()
    for m in {r[0] for r in data}:
        mine = sorted((d for d in data if d[0] == m), key=lambda d: (d[1] is not None, d[1] or at(0), d[4]))
        for k, d in enumerate(mine):
            want.add((d[4], int(any(x[2] == "FAULT" for x in mine[k + 1 : k + 6]))))
    got = labels.label_next_rows(df, 5, ["event_time", "event_id"], bucket_s=bucket_s)
    assert as_set(got, "event_id", "label_fault_next_5m") == want


def row_exchanges(df, wide):
    """Executed exchanges that carry the column ``wide``, each counted once, and the whole plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    lines = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    return lines, final


def test_row_order_operators_exchange_the_rows_once(spark, tmp_path):
    rows = machine_rows(seed=6, n=3000)
    path = str(tmp_path / "rows")
    frame(spark, rows).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.read.parquet(path)
        for got in (
            labels.label_next_rows(df, 3, ["event_time", "event_id"], bucket_s=60),
            labels.change_points(df.withColumn("seen", F.col("event_time")), "machine_id", "event_time", "seen", bucket_s=60),
        ):
            lines, plan = row_exchanges(got, "event_id")
            by_rows = [line for line in lines if "REPARTITION_BY_COL" in line]
            assert len(by_rows) == 1 and "ReusedExchange" in plan, plan
            # The other exchanges carry one boundary row per bucket.
            assert len(lines) <= 3, plan
            assert "Checkpoint" not in plan and "Scan ExistingRDD" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_machine_is_spread_over_its_buckets(spark):
    """A third of the rows on one machine: no task of the row exchange holds them together."""
    times = [("HOT" if i % 3 == 0 else f"M{i % 50}", at(i * 0.5), i) for i in range(20_000)]
    df = spark.createDataFrame(times, "machine_id string, event_time timestamp, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = bucketed(df, ["machine_id"], "event_time", 60)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("bucket_s", [1, 25, 1000])
def test_change_points(spark, bucket_s):
    seen = [(0, 1), (10, 1), (20, 2), (30, 2), (40, None), (50, 2), (60, 1), (70, 3)]
    polls = [("A", at(t + 100), None if v is None else at(v)) for t, v in seen] + [("B", at(100), at(9))]
    df = spark.createDataFrame(polls, "machine_id string, poll_time timestamp, seen timestamp")
    got = labels.change_points(df, "machine_id", "poll_time", "seen", bucket_s=bucket_s)
    assert sorted(as_set(got, "poll_time", "seen", "lag_ms")) == [
        (at(120), at(2), 118000.0),
        (at(160), at(1), 159000.0),
        (at(170), at(3), 167000.0),
    ]


@pytest.mark.parametrize("bucket_s", [0.5, 30, 5000])
def test_change_points_match_brute_force(spark, bucket_s):
    rng = random.Random(8)
    polls = []
    for i in range(900):
        machine = None if rng.random() < 0.05 else ("HOT" if rng.random() < 0.4 else f"M{rng.randrange(4)}")
        polls.append((machine, at(rng.randrange(600)), None if rng.random() < 0.1 else at(rng.randrange(4)), i))
    df = spark.createDataFrame(polls, "machine_id string, poll_time timestamp, seen timestamp, poll int").repartition(5)
    want = set()
    for m in {p[0] for p in polls}:
        mine = sorted((p[1], p[2]) for p in polls if p[0] == m and p[2] is not None)
        want |= {(m, *b) for a, b in zip(mine, mine[1:]) if a[1] != b[1]}
    got = labels.change_points(df, "machine_id", "poll_time", "seen", bucket_s=bucket_s)
    assert as_set(got, "machine_id", "poll_time", "seen") == want
    assert got.columns == ["machine_id", "poll_time", "seen", "poll", "lag_ms"]


def test_probe_samples_from_a_known_run(spark):
    lags = [124169.8, 100731.7, 121232.9, 133501.8]
    df = spark.createDataFrame([("A", v) for v in lags] + [("B", 5.0)], "machine_id string, lag_ms double")
    got = {r["machine_id"]: r for r in percentiles.probe_stats(df, ["machine_id"]).collect()}
    a, b = got["A"], got["B"]
    assert (a["samples"], a["min_ms"], a["p50_ms"], a["p95_ms"], a["max_ms"]) == (4, 100731.7, 124169.8, 133501.8, 133501.8)
    assert round(a["mean_ms"], 1) == 119909.1 and round(a["stdev_ms"], 1) == 13813.5
    assert b["stdev_ms"] is None and b["p95_ms"] == 5.0


def test_order_statistics_with_a_hot_group(spark):
    rng = random.Random(3)
    data = [("HOT" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(1000)) for _ in range(2000)]
    df = spark.createDataFrame(data, "k string, v int").repartition(7)
    picks = {"p10": 0.1, "p50": 0.5, "p100": 1.0}
    want = set()
    for k in {k for k, _ in data}:
        mine = sorted(v for k2, v in data if k2 == k)
        want.add((k, *[mine[min(int(len(mine) * q), len(mine) - 1)] for q in picks.values()]))
    assert as_set(percentiles.order_statistics(df, ["k"], "v", picks), "k", *picks) == want


def test_order_statistics_of_one_frequent_value(spark):
    """A value with 90 % of the rows is one row after the count, and nothing meets in one task."""
    values = [7] * 9000 + [v * 37 for v in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(8)
    picks = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    found = percentiles.order_statistics(df, [], "v", picks)
    assert found.first().asDict() == {name: sorted(values)[int(len(values) * q)] for name, q in picks.items()}
    counted = percentiles.histogram(df, [], {"m": F.col("v")})
    steps = percentiles.values_at(counted, [], [("m", "mid", lambda n: n / 2)])
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert counted.count() == len(set(values))


def test_weighted_percentile_equals_plain(spark):
    rng = random.Random(4)
    data = [(f"k{rng.randrange(3)}", None if rng.random() < 0.1 else rng.randrange(50)) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, v bigint")
    qs = (0.0, 0.5, 0.95, 1.0)
    counted = percentiles.with_percentiles(percentiles.histogram(df, ["k"], {"m": F.col("v")}), ["k"], {"m": qs})
    for q in qs:
        found = percentiles.weighted_percentiles("m", [q])[0]
        got = counted.groupBy("k").agg(found.alias("p"))
        assert as_set(got) == as_set(df.groupBy("k").agg(F.percentile("v", F.lit(q)).alias("p")))


def test_threshold_and_cause(spark):
    df = spark.createDataFrame(
        [(85.0, 1.0, 1.0, 100), (84.9, 9.5, 1.0, 2001), (84.9, 9.5, 1.0, 2000), (90.0, 9.9, 12.0, 2500), (None, None, None, None)],
        "temp_c double, vibration_mm_s double, current_amps double, rpm int",
    )
    got = df.select(labels.threshold_crossed().alias("t"), labels.fault_classify().alias("c")).collect()
    assert [tuple(r) for r in got] == [
        (True, "OVERTEMP"), (True, "BEARING_WEAR"), (True, "VIBRATION"), (True, "OVERCURRENT"), (False, "VIBRATION"),
    ]


def test_exact_value_at_any_position(spark):
    rng = random.Random(9)
    tiny = 5e-324
    values = [rng.gauss(0, 1) for _ in range(700)] + [0.25] * 200 + [1e300, -1e300, tiny, 2 * tiny, float("inf"), float("-inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
    for at_ in (0, 1, 2, 3, 400, 500, 650, len(values) - 2, len(values) - 1, len(values) + 50):
        assert percentiles.exact_value_at(df, "v", lambda n: at_, bins=16) == sorted(values)[min(at_, len(values) - 1)]
    assert percentiles.exact_value_at(df.where("v is null"), "v", lambda n: 0) is None
    few = spark.createDataFrame([(0.0,), (tiny,), (tiny,), (3 * tiny,)], "v double")
    assert [percentiles.exact_value_at(few, "v", lambda n: k) for k in range(4)] == [0.0, tiny, tiny, 3 * tiny]
