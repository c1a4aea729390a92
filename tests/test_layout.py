"""Stored telemetry from which a look at one machine reads little."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from fleetlens.sinks import layout
from fleetlens.streaming import jobs
from tests.conftest import as_set, at

KINDS = "machine_id string, event_time timestamp, v int"


def rows(spark, days=3, machines=40, per_day=200):
    data = [
        (f"MC-{m:04d}", at(86_400 * d + k * 400 + m), k) for d in range(days) for m in range(machines) for k in range(per_day // 10)
    ]
    return spark.createDataFrame(data, KINDS).repartition(4)


def scan(df):
    """Files and rows the scans of ``df`` read, and the text of its plan."""
    spark_conf = df.sparkSession.conf
    spark_conf.set("spark.sql.maxMetadataStringLength", "2000")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, files, read = plan.collectLeaves(), 0, 0
    stages = [leaves.apply(i) for i in range(leaves.size())]
    for leaf in stages:
        metrics = leaf.metrics()
        if metrics.contains("numFiles"):
            files += metrics.apply("numFiles").value()
            read += metrics.apply("numOutputRows").value()
    text = plan.toString()
    spark_conf.unset("spark.sql.maxMetadataStringLength")
    return files, read, text


def test_a_lookup_skips_dates_files_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    table = layout.with_date(rows(spark))
    layout.write_sorted(table, path, rows_per_file=100)
    stored = spark.read.parquet(path)
    total, in_all = stored.count(), len(stored.inputFiles())
    assert total == table.count() and in_all >= 20
    found = layout.machine_between(stored, "MC-0007", at(86_400), at(86_400 + 4000))
    files, read, plan = scan(found)
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(machine_id,MC-0007)" in pushed and "GreaterThanOrEqual(event_time" in pushed
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert files <= in_all / 3 + 1  # the other dates' files are not opened
    assert read <= 200 < total / 3 / 3  # most row groups of the date are skipped by their statistics
    want = table.where("machine_id = 'MC-0007'").where(F.col("event_time").between(at(86_400), at(86_400 + 4000)))
    assert as_set(found) == as_set(want)


def bloom_offsets(spark, file):
    """Place of each column's Bloom filter in the first row group; negative for none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration())
    )
    try:
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        return {columns.get(i).getPath().toDotString(): columns.get(i).getBloomFilterOffset() for i in range(columns.size())}
    finally:
        reader.close()


def test_bloom_filters_skip_unsorted_files(spark, tmp_path):
    """Every file spans all machine names but holds few of them, as a stream writes them.

    Without dictionaries, as in row groups with too many machines for one; below that the
    dictionary of a row group skips it just the same and no filter is written.
    """
    src = str(tmp_path / "src")
    table = layout.with_date(rows(spark, days=1))
    group = F.pmod(F.xxhash64("machine_id"), F.lit(8))
    ends = [(name, at(86_399), -1) for name in ("MC-0000", "MC-9999")]  # statistics exclude nothing
    for k in range(8):
        part = table.where(group == k).unionByName(layout.with_date(spark.createDataFrame(ends, KINDS)))
        part.coalesce(1).write.mode("append").parquet(src)
    one, read = table.where("machine_id = 'MC-0011'").count(), {}
    for name, options in (("with", layout.bloom_options()), ("without", {})):
        out, cp = str(tmp_path / name), str(tmp_path / f"{name}-cp")
        stream = jobs.stream_table(spark, src, table.schema, 1)
        options = options | {"parquet.enable.dictionary": "false"}
        jobs.append_files(stream, out, cp, jobs.AVAILABLE_NOW, partition_by=(layout.DATE,), options=options).awaitTermination()
        stored = spark.read.parquet(out)
        offsets = bloom_offsets(spark, stored.inputFiles()[0])
        assert (offsets["machine_id"] > 0) == (name == "with") and offsets["v"] < 0
        files, read[name], _ = scan(stored.where("machine_id = 'MC-0011'"))
        assert files == 8
    assert one <= read["with"] < stored.count() / 4 < read["without"] == stored.count()


def test_the_silver_stream_asks_for_bloom_filters(spark, frames, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(jobs, "append_files", lambda *a, **k: seen.update(k))
    jobs.start_silver(frames.bronze_text, "out", "cp")
    assert seen == {"partition_by": ("event_date",), "options": layout.bloom_options()}


def test_settle_rewrites_closed_dates_once_and_again_after_late_rows(spark, tmp_path):
    live, settled = str(tmp_path / "live"), str(tmp_path / "settled")
    table = layout.with_date(rows(spark))
    table.repartition(12).write.partitionBy(layout.DATE).parquet(live)
    assert as_set(layout.read_layout(spark, live, settled)) == as_set(table)
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    assert layout.settle(spark, live, settled, days[2], rows_per_file=150) == days[:2]
    assert layout.settle(spark, live, settled, days[2]) == []
    both = layout.read_layout(spark, live, settled)
    assert as_set(both) == as_set(table) and both.count() == table.count()
    assert {f.split("/")[-3] for f in both.inputFiles()} == {"live", "settled"}
    assert len(spark.read.parquet(settled).inputFiles()) < len([f for f in spark.read.parquet(live).inputFiles() if "01-03" not in f])
    late = layout.with_date(spark.createDataFrame([("MC-0001", at(10), -5)], KINDS))
    late.write.mode("append").partitionBy(layout.DATE).parquet(live)
    assert layout.settle(spark, live, settled, days[2]) == days[:1]
    assert as_set(layout.read_layout(spark, live, settled)) == as_set(table.unionByName(late))
    # Rows without a time have no date: they are never settled, and stay readable.
    none = layout.with_date(spark.createDataFrame([("MC-0001", None, -6)], KINDS))
    none.write.mode("append").partitionBy(layout.DATE).parquet(live)
    assert layout.settle(spark, live, settled, days[2]) == []
    assert as_set(layout.read_layout(spark, live, settled)) == as_set(table.unionByName(late).unionByName(none))


def test_empty_rows_write_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.write_sorted(layout.with_date(spark.createDataFrame([], KINDS)), path)
    assert not (tmp_path / "t").exists()


@pytest.mark.parametrize("days, want", [(0, date(2024, 1, 11)), (1, date(2024, 1, 10)), (3, date(2024, 1, 8))])
def test_closed_before(days, want):
    assert layout.closed_before(date(2024, 1, 10), days) == want
