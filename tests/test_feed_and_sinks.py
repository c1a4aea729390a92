"""Change feed, sinks with tokens and incremental scores: late, equal, replayed and failing input."""

import os
import sys

import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fleetlens.functions.expr import instant
from fleetlens.ml import isolation_forest
from fleetlens.ml.isolation_forest import IsolationForest, IsolationForestModel
from fleetlens.ml.scoring_log import ScoringLog, score_new, start_scoring
from fleetlens.ml.store import ModelStore
from fleetlens.operators.latest import latest_by_key
from fleetlens.sinks.retry import FolderSink, write_partitions
from fleetlens.streaming import feed, jobs
from tests.conftest import as_set, at

# Workers cannot import this module; what they need of it travels with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = "machine_id string, last_event_time timestamp, state string, big long, x double"


@pytest.fixture
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def send(spark, path, *batches, kinds=KINDS):
    """One file per batch, in this order."""
    os.makedirs(path, exist_ok=True)
    for rows in batches:
        n = len(os.listdir(path))
        name = f"{path}/{n:04d}.parquet"
        pq.write_table(spark.createDataFrame(rows, kinds).toArrow(), name)
        os.utime(name, (1_700_000_000 + n, 1_700_000_000 + n))


# --- change feed -------------------------------------------------------------------------


def test_feed_of_late_equal_and_replayed_rows(spark, tmp_path, one_partition):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    big = 2**60 + 1
    first = [("A", at(10), "RUN", big, 0.1), ("A", at(5), "OLD", 1, None), ("B", at(1), "RUN", None, 1.5), (None, at(1), "X", 1, 1.0)]
    second = [
        ("A", at(9.5), "LATE", 2, 2.0),  # older than the state: nothing
        ("B", at(1), "RUN", None, 1.5),  # the same again: nothing
        ("C", None, "NOTIME", 3, 3.0),
        ("A", at(10), "RUN", big, 0.1),
    ]
    third = [("A", at(10.000001), "FAULT", None, float("nan")), ("A", at(10), "RUN", big, 0.1), ("C", at(0), "RUN", 4, 4.0)]
    send(spark, src, first, second, third)
    run = lambda: feed.start_change_feed(jobs.stream_table(spark, src, KINDS, 1), out, cp, tiebreak="big").awaitTermination()
    run()
    changes = spark.read.parquet(out)
    got = sorted(
        (str(r.machine_id), r.version, r.change, r.changed_at, r.before and r.before.state, r.after.state) for r in changes.collect()
    )
    assert got == [
        ("A", 1, "insert", at(10), None, "RUN"),
        ("A", 2, "update", at(10.000001), "RUN", "FAULT"),
        ("B", 1, "insert", at(1), None, "RUN"),
        ("C", 1, "insert", None, None, "NOTIME"),
        ("C", 2, "update", at(0), "NOTIME", "RUN"),
        ("None", 1, "insert", at(1), None, "X"),
    ]
    images = {(r.machine_id, r.version): r for r in changes.collect()}
    assert images["A", 1].after.big == images["A", 2].before.big == big and images["A", 2].after.big is None
    sent = spark.createDataFrame(first + second + third, KINDS)
    applied = feed.apply_feed(changes)
    want = latest_by_key(sent, ["machine_id"], ["last_event_time"], ["big"])
    assert as_set(applied, "machine_id", "last_event_time", "state", "big") == as_set(want, "machine_id", "last_event_time", "state", "big")
    # A restart with the first rows sent again gives no change.
    send(spark, src, first)
    run()
    assert spark.read.parquet(out).count() == len(got)


def test_feed_drops_machines_that_fell_silent(spark, tmp_path, one_partition):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    a, b, again = ("A", at(0), "RUN", 1, 1.0), ("B", at(5), "RUN", 2, 2.0), ("A", at(9000), "RUN", 3, 3.0)
    send(spark, src, [a, b], [("B", at(400), "RUN", 2, 2.0)], [("B", at(1500), "RUN", 2, 2.0)], [("B", at(1600), "RUN", 2, 2.0)], [again])
    source = jobs.stream_table(spark, src, KINDS, 1)
    feed.start_change_feed(source, out, cp, expire="10 minutes").awaitTermination()
    changes = spark.read.parquet(out)
    got = [(r.change, r.version, r.before and r.before.big, r.after and r.after.big) for r in changes.where("machine_id = 'A'").orderBy("changed_at").collect()]
    assert got == [("insert", 1, None, 1), ("delete", 2, 1, None), ("insert", 1, None, 3)]
    last = as_set(feed.apply_feed(changes), "machine_id", "big")
    assert ("A", 3) in last  # what came back counts, although its version began again
    assert as_set(feed.apply_feed(changes.where(F.col("changed_at") < F.lit(at(2000)))), "machine_id") == {("B",)}


# --- sinks with tokens -------------------------------------------------------------------


class Flaky(FolderSink):
    """Fails ``times`` times on partition ``part`` of the batch, remembered in a folder."""

    def __init__(self, folder, log, part, times):
        super().__init__(folder)
        self._log, self._part, self._times = log, part, times

    def write(self, token, rows):
        part = token.rsplit("-", 1)[1]
        tries = len([n for n in os.listdir(self._log) if n.startswith(f"{part}-")])
        open(f"{self._log}/{part}-{tries}", "w").close()
        if part == str(self._part) and tries < self._times:
            raise OSError("sink is down")
        super().write(token, rows)


def alerts(spark, n=400):
    return [(f"M{i}", at(i), "RUN", i, 1.0) for i in range(n)]


def test_a_failing_partition_is_tried_again(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    os.makedirs(log)
    df = spark.createDataFrame(alerts(spark), KINDS)
    report = write_partitions(df, Flaky(out, log, 1, 2), "q-0", "machine_id", 4, first_wait_s=0.01).collect()
    assert [(r.part, r.attempts) for r in report] == [(0, 1), (1, 3), (2, 1), (3, 1)]
    assert sum(r.n for r in report) == 400 and as_set(spark.read.schema(KINDS).parquet(out)) == as_set(df)
    again = write_partitions(df.repartition(9), Flaky(out, log, 1, 0), "q-0", "machine_id", 4).collect()
    assert [r.attempts for r in again] == [0, 0, 0, 0]  # every token was there


def test_a_replay_writes_only_what_is_missing(spark, tmp_path):
    """The second of four partitions fails once, beyond its attempts: the error ends the query, the replay completes it."""
    src, log, out, cp = (str(tmp_path / n) for n in ("src", "log", "out", "cp"))
    os.makedirs(log)
    send(spark, src, alerts(spark))
    source = jobs.stream_table(spark, src, KINDS)

    def run():
        jobs.start_to_sink(source, Flaky(out, log, 1, 1), cp, "machine_id", 4, attempts=1).awaitTermination()

    with pytest.raises(Exception, match="sink is down"):
        run()
    first = set(os.listdir(out))
    run()
    tries = sorted(n.split("-")[0] for n in os.listdir(log))
    assert tries.count("1") == 2 and all(tries.count(p) == 1 for p in {n.rsplit("-", 1)[1][0] for n in first if "_" != n[0]})
    assert as_set(spark.read.schema(KINDS).parquet(out)) == as_set(spark.createDataFrame(alerts(spark), KINDS))
    assert spark.read.schema(KINDS).parquet(out).count() == 400
    run()  # nothing new: nothing is written
    assert len(os.listdir(log)) == 5


def test_waits_grow_and_the_last_error_is_raised(spark, tmp_path):
    log, waits = str(tmp_path / "log"), str(tmp_path / "waits")
    os.makedirs(log)
    df = spark.createDataFrame(alerts(spark, 50), KINDS)

    def wait(seconds):
        with open(waits, "a") as out:
            out.write(f"{seconds} ")

    with pytest.raises(Exception, match="sink is down"):
        write_partitions(df, Flaky(str(tmp_path / "out"), log, 0, 99), "q-1", "machine_id", 1, attempts=4, wait=wait).collect()
    assert open(waits).read().split() == ["0.5", "1.0", "2.0"]


def test_an_empty_batch_writes_nothing(spark, tmp_path):
    report = write_partitions(spark.createDataFrame([], KINDS), FolderSink(str(tmp_path / "out")), "q-2", "machine_id", 2)
    assert [(r.n, r.attempts) for r in report.collect()] == [(0, 0), (0, 0)] and not (tmp_path / "out").exists()


# --- incremental scores ------------------------------------------------------------------


@pytest.fixture(scope="module")
def forest(frames):
    return IsolationForest(n_trees=5, sample_size=64).fit(isolation_forest.training_frame(frames.silver, frames.as_of))


def test_two_runs_score_each_row_once(spark, frames, forest, tmp_path):
    log = ScoringLog(spark, str(tmp_path / "log"))
    rows = isolation_forest.training_frame(frames.silver, frames.as_of)
    half = frames.as_of - 9_000_000_000
    early = rows.where(F.unix_micros("event_time") <= half)
    assert log.read() is None and log.marks() == {}
    assert score_new(early, forest, log, half, "r1", ["batch"], keep=("event_id",))
    first = log.read().count()
    assert score_new(rows, forest, log, frames.as_of, "r2", ["batch"], keep=("event_id",))
    scored = log.read()
    assert 0 < first < scored.count() == rows.count() == scored.select("event_id").distinct().count()
    assert not score_new(rows, forest, log, frames.as_of, "r2", ["batch"], keep=("event_id",))  # replayed
    assert score_new(rows, forest, log, frames.as_of, "r3", ["batch"], keep=("event_id",))  # nothing new
    assert log.read().count() == rows.count()
    # The other mode has a mark of its own.
    score_new(rows, forest, log, frames.as_of, "r4", ["realtime"], keep=("event_id",))
    assert log.read().where("inference_type = 'realtime'").count() > 0
    assert log.marks()["batch"] == log.marks()["realtime"] == frames.as_of


def test_a_run_that_died_before_its_mark_still_counts(spark, frames, forest, tmp_path):
    import shutil

    log = ScoringLog(spark, str(tmp_path / "log"))
    rows = isolation_forest.training_frame(frames.silver, frames.as_of)
    score_new(rows, forest, log, frames.as_of, "r1", ["batch"])
    shutil.rmtree(tmp_path / "log" / "marks")
    os.makedirs(tmp_path / "log" / "scores" / "run=r0")  # no marker: not complete
    score_new(rows, forest, log, frames.as_of, "r2", ["batch"])
    assert log.read().count() == rows.count()


def test_a_stream_loads_a_model_once_per_version(spark, frames, forest, tmp_path):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    store, log = ModelStore(spark, str(tmp_path / "models")), ScoringLog(spark, str(tmp_path / "log"))
    rows = isolation_forest.training_frame(frames.silver, frames.as_of)
    saved, loads = forest.save(store), []

    def load(models):
        loads.append(models.latest(isolation_forest.KIND)[0])
        return IsolationForestModel.load_latest(models)

    def run(part):
        rows.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(src)
        source = jobs.stream_table(spark, src, rows.schema, 1)
        start_scoring(source, store, log, cp, scored_at=instant(frames.as_of), keep=("event_id",), load=load).awaitTermination()

    for part in (0, 1):
        rows.where(F.col("event_id") % 4 == part + 2).coalesce(1).write.mode("append").parquet(src)
        run(part)
    assert loads == [saved.run_id] * 2  # two runs of two batches each
    scored = log.read()
    assert scored.count() == rows.count() == scored.select("event_id").distinct().count()
    assert as_set(scored, "model_run_id") == {(saved.run_id,)}
