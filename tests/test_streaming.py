"""Streams against the batch operators: closed windows, restart, late rows, replay."""

import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fleetlens.operators import gold
from fleetlens.operators.latest import latest_by_key
from fleetlens.sinks.keyed import KeyedTable
from fleetlens.streaming import jobs
from tests.conftest import as_set, at

TIE = ("event_id",)


def stored_silver(frames, path, files=4):
    """Silver rows as files, oldest first, one file per quarter of the time span."""
    silver = frames.silver
    low, high = silver.agg(F.min(F.unix_millis("event_time")), F.max(F.unix_millis("event_time"))).first()
    step = (high - low) // files + 1
    part = ((F.unix_millis("event_time") - low) / step).cast("int")
    for i in range(files):
        silver.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return silver


def stream(spark, path, schema, max_files=None):
    return jobs.stream_table(spark, path, schema, max_files)


def test_health_over_several_batches_equals_closed_batch_windows(spark, frames, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    silver = stored_silver(frames, src)
    query = jobs.start_health(stream(spark, src, silver.schema, 1), out, cp)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    newest = silver.agg(F.max("event_time")).first()[0]
    want = frames.gold.where(F.col("window_end") <= F.lit(newest) - F.expr("interval 2 minutes"))
    assert as_set(spark.read.parquet(out), *want.columns) == as_set(want)
    assert 0 < want.count() < frames.gold.count()


def test_restart_continues_from_the_checkpoint(spark, frames, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    silver = frames.silver
    half = F.timestamp_micros(F.lit(frames.as_of - 9_000_000_000))
    early = silver.where(F.col("event_time") < half).coalesce(1)
    early.write.parquet(src)
    jobs.start_status(stream(spark, src, silver.schema), out, cp, tiebreak=TIE).awaitTermination()
    first = spark.read.parquet(out).count()
    silver.where(F.col("event_time") >= half).coalesce(1).write.mode("append").parquet(src)
    jobs.start_status(stream(spark, src, silver.schema), out, cp, tiebreak=TIE).awaitTermination()
    newest = silver.agg(F.max("event_time")).first()[0]
    end = (F.floor(F.unix_millis("last_event_time") / 10_000) + 1) * 10_000
    closed = end <= F.unix_millis(F.lit(newest)) - 10_000
    want = gold.status_windows(silver, tiebreak=TIE).where(closed)
    got = spark.read.parquet(out)
    assert 0 < first < got.count()
    assert as_set(got, *want.columns) == as_set(want) and got.count() == want.count()


LATE_KINDS = "machine_id string, event_time timestamp, big long, n int"


def late_files(path, batches):
    """A file per batch, a minute of one row per machine each; every fifth file also has rows an hour old."""
    os.makedirs(path)
    kinds = pa.schema([("machine_id", pa.string()), ("event_time", pa.timestamp("us", "UTC")), ("big", pa.int64()), ("n", pa.int32())])
    sent = []
    for k in range(batches):
        rows = [(f"M{m}", at(60 * k + m), 2**60 + k, k if m else None) for m in range(3)]
        if k % 5 == 4:
            rows += [("M0", at(60 * k - 3600 + j), None, -1) for j in range(4)]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
        pq.write_table(table, f"{path}/{k:04d}.parquet")
        os.utime(f"{path}/{k:04d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        sent += rows
    return sent


def wait_for(test):
    """Progress reports arrive shortly after their batch."""
    end = time.time() + 20
    while not test() and time.time() < end:
        time.sleep(0.1)
    return test()


def per_window(df):
    counted = df.withWatermark("event_time", "2 minutes").groupBy(F.window("event_time", "5 minutes")).agg(F.count("*").alias("n"))
    return counted.select("window.start", "n")


def test_late_rows_over_more_batches_than_reports_are_kept(spark, tmp_path):
    src, plain, cp, out, ocp, windows, wcp = (str(tmp_path / n) for n in "src plain cp out ocp windows wcp".split())
    sent = late_files(src, 105)
    old = {r for r in sent if r[3] == -1}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        source = stream(spark, src, LATE_KINDS, 1)
        with jobs.LateCounter(spark) as late:
            dropping = jobs.append_files(per_window(source), plain, cp, jobs.AVAILABLE_NOW)
            dropping.awaitTermination()
            assert wait_for(lambda: late.batches(dropping) >= 105)
            # The old rows of a file are one group of the aggregate.
            assert late.dropped(dropping) == len(old) / 4 and len(dropping.recentProgress) <= 100
            # Kept apart instead: rows in are rows on time and late rows, each as it was sent.
            jobs.start_routed(source, out, ocp).awaitTermination()
            routed = spark.read.parquet(out)
            assert as_set(routed, "machine_id", "event_time", "big", "n") == set(sent) and routed.count() == len(sent)
            assert as_set(routed.where("late = 1"), "machine_id", "event_time", "big", "n") == old
            accepted = stream(spark, out, routed.schema, 30).where("late = 0")
            counting = jobs.append_files(per_window(accepted), windows, wcp, jobs.AVAILABLE_NOW)
            counting.awaitTermination()
            assert wait_for(lambda: late.batches(counting) >= 3) and late.dropped(counting) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = as_set(routed.where("late = 0").groupBy(F.window("event_time", "5 minutes").start.alias("start")).count())
    assert as_set(spark.read.parquet(windows), "start", "n") <= want
    assert as_set(spark.read.parquet(windows)) == as_set(spark.read.parquet(plain))


def test_a_restart_remembers_what_was_published(spark, frames, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    silver = frames.silver
    old = F.col("event_time") < F.timestamp_micros(F.lit(frames.as_of - 7_200_000_000))
    silver.coalesce(1).write.parquet(src)
    jobs.start_routed(stream(spark, src, silver.schema), out, cp).awaitTermination()
    silver.where(old).coalesce(1).write.mode("append").parquet(src)
    jobs.start_routed(stream(spark, src, silver.schema), out, cp).awaitTermination()
    routed = spark.read.parquet(out)
    assert as_set(routed.where("late = 1"), *silver.columns) == as_set(silver.where(old))
    assert as_set(routed.where("late = 0"), *silver.columns) == as_set(silver)


def test_latest_ignores_older_rows_and_replays(spark, frames, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    rows = frames.silver.select("machine_id", F.col("event_time").alias("last_event_time"), "state", *TIE)
    cut = F.timestamp_micros(F.lit(frames.as_of - 3_600_000_000))
    # Newest rows first, then the older ones arrive.
    rows.where(F.col("last_event_time") >= cut).coalesce(1).write.parquet(src)
    changes = []
    keep = lambda batch, number: changes.append((number, batch.count()))

    def run(checkpoint):
        source = stream(spark, src, rows.schema, 1)
        jobs.start_latest(source, out, checkpoint, tiebreak=TIE, on_change=keep).awaitTermination()

    run(cp)
    table = KeyedTable(spark, out, ("machine_id",), ("last_event_time",))
    first = as_set(table.read())
    rows.where(F.col("last_event_time") < cut).coalesce(1).write.mode("append").parquet(src)
    run(cp)
    want = as_set(latest_by_key(rows, ["machine_id"], ["last_event_time"], TIE))
    assert as_set(table.read()) == want and first <= want
    assert len(changes) >= 2 and changes[0][1] == len(first)
    # A new checkpoint numbers its batches from 0 again; they must not be taken for replays.
    published = len(table.versions())
    run(str(tmp_path / "cp2"))
    assert as_set(table.read()) == want
    assert table.versions()[-1].number > published


def test_a_failing_batch_stops_the_query_and_is_replayed(spark, frames, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    rows = frames.silver.select("machine_id", F.col("event_time").alias("last_event_time"), "state", *TIE)
    rows.coalesce(1).write.parquet(src)

    def broken(batch, number):
        raise RuntimeError("sink is down")

    source = stream(spark, src, rows.schema)
    query = jobs.start_latest(source, out, cp, tiebreak=TIE, on_change=broken)
    try:
        query.awaitTermination()
        raised = False
    except Exception:
        raised = True
    assert raised
    seen = []
    source = stream(spark, src, rows.schema)
    jobs.start_latest(source, out, cp, tiebreak=TIE, on_change=lambda b, n: seen.append(b.count())).awaitTermination()
    machines = rows.select("machine_id").distinct().count()
    assert seen[0] == machines  # nothing was lost
    table = KeyedTable(spark, out, ("machine_id",), ("last_event_time",))
    assert table.read().count() == machines and len(table.versions()) == 1


def test_silver_stream_reports_rule_violations(spark, frames, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    frames.bronze_text.coalesce(1).write.parquet(src)
    query = jobs.start_silver(stream(spark, src, frames.bronze_text.schema), out, cp, keep=TIE)
    query.awaitTermination()
    seen = [p["observedMetrics"]["row_quality"] for p in query.recentProgress if p["numInputRows"]]
    assert seen[0]["rows_checked"] == frames.silver.count()
    assert seen[0]["valid_state"] == frames.silver.where("state = 'UNKNOWN'").count()
    stored = spark.read.parquet(out)
    assert "event_date" in stored.columns
    assert as_set(stored, *frames.silver.columns) == as_set(frames.silver)


def test_rocksdb_state(spark, frames, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    silver = stored_silver(frames, src, files=2)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    jobs.use_rocksdb(spark)
    try:
        jobs.start_health(stream(spark, src, silver.schema, 1), out, cp).awaitTermination()
    finally:
        spark.conf.set(key, before)
    assert spark.read.parquet(out).count() > 0
