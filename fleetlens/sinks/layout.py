"""A layout of stored telemetry in which a look at one machine reads little.

Files lie in ``event_date`` folders, which Spark prunes before it opens a file.  Streams write
their files with Parquet Bloom filters on the machine, so row groups without it are skipped
(Parquet writes one where a row group has too many machines for a dictionary, which skips as well).
Closed dates are settled: rewritten once, sorted by machine and time into files of bounded size,
so the smallest and largest machine of a row group exclude nearly all of them.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.expr import instant
from fleetlens.plans.semantic import AsOf

DATE = "event_date"
ROWS_PER_FILE = 2_000_000


def bloom_options(column: str = "machine_id", distinct: int = 100_000) -> dict[str, str]:
    """Writer options for a Bloom filter per row group, sized for ``distinct`` values."""
    return {
        f"parquet.bloom.filter.enabled#{column}": "true",
        f"parquet.bloom.filter.expected.ndv#{column}": str(distinct),
    }


def with_date(rows: DataFrame, time: str = "event_time") -> DataFrame:
    return rows.withColumn(DATE, F.to_date(time))


def write_sorted(
    rows: DataFrame, path: str, key: str = "machine_id", time: str = "event_time", rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Replace the dates that ``rows`` (with ``event_date``) hold; other dates stay.

    One range exchange by date, machine and time: a machine with a third of a date's rows takes
    a third of its files.
    """
    n = rows.count()
    if n == 0:
        return
    order = [DATE, key, time]
    dealt = rows.repartitionByRange(-(-n // rows_per_file), *order).sortWithinPartitions(*order)
    writer = dealt.write.mode("overwrite").partitionBy(DATE).options(**bloom_options(key))
    writer.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).parquet(path)


def _counts(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows per date, from file footers; none for a table that is not there yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], f"{DATE} date, n long")
    return spark.read.schema(schema).parquet(path).groupBy(DATE).agg(F.count(F.lit(1)).alias("n"))


def settle(spark: SparkSession, live: str, settled: str, before: date, key: str = "machine_id", **kwargs) -> list[date]:
    """Rewrite the dates before ``before`` whose rows at ``live`` are not all at ``settled`` yet.

    Run it periodically: a date that got late rows is written again, others are left alone, and
    a run that died is repaired by the next.  Returns the dates written.
    """
    table = spark.read.parquet(live)
    there = _counts(spark, live, table.schema).where((F.col(DATE) < F.lit(before)) & F.col(DATE).isNotNull())
    done = _counts(spark, settled, table.schema).withColumnRenamed("n", "done")
    changed = there.join(done, DATE, "left").where(~F.col("n").eqNullSafe(F.col("done")))
    dates = sorted(r[DATE] for r in changed.select(DATE).collect())
    if dates:
        write_sorted(table.where(F.col(DATE).isin(dates)), settled, key, **kwargs)
    return dates


def read_layout(spark: SparkSession, live: str, settled: str) -> DataFrame:
    """All rows: settled dates from the sorted files, the dates after them as the stream wrote them.

    Late rows of a settled date appear with the next :func:`settle`.
    """
    table = spark.read.parquet(live)
    done = _counts(spark, settled, table.schema).agg(F.max(DATE)).first()[0]
    if done is None:
        return table
    sorted_rows = spark.read.schema(table.schema).parquet(settled)
    rest = table.where((F.col(DATE) > F.lit(done)) | F.col(DATE).isNull())
    return sorted_rows.where(F.col(DATE) <= F.lit(done)).unionByName(rest)


def machine_between(
    rows: DataFrame, machine: str, start: AsOf, end: AsOf, key: str = "machine_id", time: str = "event_time"
) -> DataFrame:
    """Rows of one machine between two times (both included), pruned by date, machine and time."""
    first, last = instant(start), instant(end)
    dates = F.col(DATE).between(F.to_date(first), F.to_date(last))
    return rows.where(dates & (F.col(key) == machine) & F.col(time).between(first, last))


def closed_before(newest: date, open_days: int = 1) -> date:
    """Dates before this are settled when the newest event is of date ``newest``."""
    return newest - timedelta(days=open_days - 1)
