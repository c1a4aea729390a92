"""Mirror statements and run order (with stand-ins for the database), and the checks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetlens import ops
from fleetlens.schemas import BRONZE, MIRROR_STATUS
from fleetlens.sinks import jdbc
from fleetlens.streaming import jobs
from tests.conftest import as_set, at


def test_postgres_upsert():
    sql = jdbc.merge_statement("t", "s", ["k"], ["k", "a", "b"])
    assert sql == (
        "INSERT INTO t (k, a, b) SELECT k, a, b FROM s "
        "ON CONFLICT (k) DO UPDATE SET a = EXCLUDED.a, b = EXCLUDED.b, updated_at = CURRENT_TIMESTAMP"
    )


def test_ansi_merge():
    sql = jdbc.merge_statement("t", "s", ["k"], ["k", "a"], "ansi", touch=None)
    assert sql == (
        "MERGE INTO t t USING s s ON t.k = s.k WHEN MATCHED THEN UPDATE SET a = s.a "
        "WHEN NOT MATCHED THEN INSERT (k, a) VALUES (s.k, s.a)"
    )
    with pytest.raises(ValueError):
        jdbc.merge_statement("t", "s", ["k"], ["k"], "other")


def test_ddl_covers_the_mirrored_columns():
    ddl = jdbc.mirror_ddl()
    assert len(ddl) == 6
    assert all(f" {n} " in ddl[0].replace("(", " ( ") for n in MIRROR_STATUS.names)


class Database:
    """Remembers what the job would have written and run."""

    def __init__(self):
        self.log, self.staged = [], {}

    def write(self, df, table):
        self.log.append(("write", table))
        self.staged[table] = df.collect()

    def execute(self, statements):
        self.log.append(("execute", len(statements)))


def test_mirror_run(frames):
    db = Database()
    bad = frames.status.limit(1).withColumn("machine_id", F.lit(""))
    status = frames.status.unionByName(bad)
    found = jdbc.upsert_jdbc(status, db.write, db.execute, dim=frames.dim, instance_id="one")
    n = frames.status.count()
    assert (found["row_count"], found["valid_rows"], found["invalid_rows"]) == (n + 1, n, 1)
    # The run is recorded after the merge.
    assert [e[0] for e in db.log] == ["write", "write", "write", "execute", "execute"]
    rows = db.staged["machine_current_status_staging"]
    assert len(rows) == n and set(rows[0].asDict()) == {*MIRROR_STATUS.names}
    run = db.staged["mirror_metadata_staging"][0]
    assert (run["instance_id"], run["row_count"]) == ("one", n)
    assert run["source_watermark"] == found["source_watermark"] == max(r["last_event_time"] for r in rows)


def test_mirror_counts_are_those_of_the_rows_written(spark):
    """A source that differs at every evaluation: what is recorded is what was staged."""
    db = Database()
    rows = spark.range(4000).select(
        F.concat(F.lit("m"), F.col("id")).alias("machine_id"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("last_event_time"),
    )
    found = jdbc.upsert_jdbc(rows.where(F.rand() < 0.5), db.write, db.execute)
    staged = db.staged["machine_current_status_staging"]
    assert 0 < found["valid_rows"] == found["row_count"] == len(staged) < 4000
    assert found["source_watermark"] == max(r["last_event_time"] for r in staged)
    assert db.staged["mirror_metadata_staging"][0]["row_count"] == len(staged)


def test_merge_keeps_newer_rows():
    columns = ["machine_id", "last_event_time", "state"]
    plain = jdbc.merge_statement("t", "s", ["machine_id"], columns, newer="last_event_time", computed={"mark": "(SELECT 1)"})
    assert plain == (
        "INSERT INTO t (machine_id, last_event_time, state, mark) SELECT machine_id, last_event_time, state, (SELECT 1) FROM s "
        "ON CONFLICT (machine_id) DO UPDATE SET last_event_time = EXCLUDED.last_event_time, state = EXCLUDED.state, "
        "mark = EXCLUDED.mark, updated_at = CURRENT_TIMESTAMP WHERE t.last_event_time IS NULL OR EXCLUDED.last_event_time >= t.last_event_time"
    )
    # The dialect with MERGE is run by the engine the tests have in process.
    con = duckdb.connect()
    con.execute("create table t (machine_id text primary key, last_event_time int, state text, mark int)")
    con.execute("create table s (machine_id text, last_event_time int, state text)")
    con.execute("insert into t values ('a', 5, 'old', 0), ('b', 9, 'old', 0), ('c', null, 'old', 0)")
    con.execute("insert into s values ('a', 6, 'new'), ('b', 8, 'new'), ('c', 1, 'new'), ('d', 1, 'new')")
    con.execute(plain.replace(", updated_at = CURRENT_TIMESTAMP", ""))
    assert con.execute("select * from t order by 1").fetchall() == [
        ("a", 6, "new", 1), ("b", 9, "old", 0), ("c", 1, "new", 1), ("d", 1, "new", 1),
    ]
    ansi = jdbc.merge_statement("t", "s", ["machine_id"], columns, "ansi", None, "last_event_time")
    assert "WHEN MATCHED AND (t.last_event_time IS NULL OR s.last_event_time >= t.last_event_time) THEN UPDATE" in ansi


def test_dry_run_and_nothing_valid_write_nothing(frames):
    db = Database()
    assert not jdbc.upsert_jdbc(frames.status, db.write, db.execute, dry_run=True)["written"]
    empty = frames.status.withColumn("last_event_time", F.lit(None).cast("timestamp"))
    assert not jdbc.upsert_jdbc(empty, db.write, db.execute)["written"]
    # Nothing valid: the staging table is written (that is the one evaluation), nothing is merged.
    assert [e[0] for e in db.log] == ["write"]


def test_continuous_sync_mirrors_every_change(spark, frames, tmp_path):
    """The change feed of the latest-status stream drives the mirror, batch by batch."""
    rows = frames.latest.drop("telemetry_lag_seconds")
    rows.coalesce(1).write.parquet(str(tmp_path / "src"))
    db = Database()
    sync = lambda batch, number: jdbc.upsert_jdbc(batch, db.write, db.execute)
    source = jobs.stream_table(spark, str(tmp_path / "src"), rows.schema)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    jobs.start_latest(source, out, cp, on_change=sync).awaitTermination()
    staged = db.staged["machine_current_status_staging"]
    assert {r["machine_id"] for r in staged} == {r["machine_id"] for r in rows.collect()}
    assert db.log.count(("execute", 1)) == 2


def test_bulk_load_bounds_connections(frames):
    parts = []
    jdbc.bulk_load(frames.requests.repartition(20), "t", lambda df, t: parts.append(df.rdd.getNumPartitions()), 4)
    assert parts == [4]


def test_parity(spark, frames):
    latest = frames.latest
    same = ops.require_parity(latest, latest)
    assert same["missing_right"] == same["missing_left"] == 0
    fewer = latest.where("machine_id <> 'MC-0004'")
    found = ops.parity_check(latest, fewer).first()
    assert (found["counts_equal"], found["missing_right"], found["missing_left"]) == (False, 1, 0)
    with pytest.raises(ops.CheckFailed):
        ops.require_parity(latest, fewer)
    swapped = fewer.unionByName(latest.limit(1).withColumn("machine_id", F.lit("new")))
    hidden = ops.parity_check(latest, swapped).first()
    assert hidden["counts_equal"] and hidden["missing_right"] == hidden["missing_left"] == 1
    none = ops.parity_check(latest.where("false"), latest.where("false")).first()
    assert (none["left_rows"], none["right_rows"]) == (0, 0)


def test_parity_finds_one_changed_row_in_one_bucket(spark, tmp_path):
    """One row of 10^5 differs: only its bucket is read row by row, and no join meets the tables."""
    rows = spark.range(100_000).select(
        F.concat(F.lit("m"), F.col("id")).alias("machine_id"),
        F.when(F.col("id") % 7 != 0, F.col("id")).alias("a"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("b"),
    )
    changed = rows.withColumn("a", F.when(F.col("machine_id") == "m4711", F.lit(-1)).otherwise(F.col("a")))
    sums = [ops.bucket_checksums(df, ["machine_id"], df.columns, 1024) for df in (rows, changed)]
    odd = ops.unequal_buckets(*sums)
    assert len(odd) == 1
    found = ops.parity_differences(rows, changed)
    assert [tuple(r) for r in found.collect()] == [("m4711", 1, 1, "unequal")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and f"= {odd[0]}" in plan
    compared = rows.where(ops._bucket(["machine_id"], 1024) == odd[0]).count()
    assert compared < 200
    assert ops.parity_differences(rows, rows.repartition(7)).count() == 0


def test_parity_differences_cases(spark):
    kinds = "k string, a int, b int"
    left = [("same", 1, None), ("nulls", None, 1), ("gone", 1, 1), ("twice", 1, 1), ("twice", 2, 2), (None, 5, 5)]
    right = [("same", 1, None), ("nulls", 1, None), ("new", 1, 1), ("twice", 2, 2), ("twice", 1, 1), (None, 5, 6)]
    found = ops.parity_differences(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), "k", buckets=4)
    assert as_set(found, "k", "difference") == {
        ("nulls", "unequal"), ("gone", "missing_right"), ("new", "missing_left"), (None, "unequal"),
    }
    none = spark.createDataFrame([], kinds)
    assert ops.parity_differences(none, none, "k").count() == 0


def test_validate_outputs(frames):
    tables = {"silver": frames.silver, "gold": frames.gold.where("false")}
    found = ops.validate_outputs(tables, ["silver"], ["gold"], {"silver": "event_time"})
    assert found["warnings"] == ["gold"] and found["newest"]["silver"] is not None
    with pytest.raises(ops.CheckFailed, match="gold"):
        ops.validate_outputs(tables, ["silver", "gold"])


def test_stream_health(frames):
    assert ops.stream_health(frames.silver, frames.as_of, minutes=60, minimum=1) > 0
    with pytest.raises(ops.CheckFailed):
        ops.stream_health(frames.silver, frames.as_of, minutes=60, minimum=10**6)


def test_preflight(spark):
    spark.sql("drop table if exists landing")
    assert ops.preflight(spark, "landing", BRONZE) == 0
    assert spark.table("landing").columns == BRONZE.names
    spark.sql("drop table landing")


def test_invalid_mirror_rows(spark):
    df = spark.createDataFrame([("a", at(0)), ("", at(0)), (None, at(0)), ("b", None)], "machine_id string, last_event_time timestamp")
    counts = jdbc.mirror_counts(df).first()
    assert tuple(counts) == (4, 1, 3, at(0)) and jdbc.valid_mirror_rows(df).count() == 1
