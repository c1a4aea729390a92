"""Training labels and change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import as_number, is_fault
from fleetlens.operators.carry import BUCKET_S, bucketed, changes, hit_ahead

# Default fault limits of temperature, vibration and current.
TEMP_LIMIT, VIBRATION_LIMIT, CURRENT_LIMIT = 85.0, 9.5, 12.0
BEARING_RPM = 2000


def threshold_crossed(
    temp: float = TEMP_LIMIT, vib: float = VIBRATION_LIMIT, amps: float = CURRENT_LIMIT
) -> Column:
    crossed = (
        (F.col("temp_c") >= temp) | (F.col("vibration_mm_s") >= vib) | (F.col("current_amps") >= amps)
    )
    return F.coalesce(crossed, F.lit(False))


def fault_classify(
    temp: float = TEMP_LIMIT,
    vib: float = VIBRATION_LIMIT,
    amps: float = CURRENT_LIMIT,
    manual: Column | None = None,
) -> Column:
    """Cause of a fault from the measured values; ``manual`` marks operator stops.

    The bearing test uses the rpm as measured before the machine spins down.
    """
    causes = [
        (F.col("current_amps") >= amps, "OVERCURRENT"),
        ((F.col("vibration_mm_s") >= vib) & (F.col("rpm") > BEARING_RPM), "BEARING_WEAR"),
        (F.col("temp_c") >= temp, "OVERTEMP"),
    ]
    if manual is not None:
        causes.insert(0, (manual, "MANUAL_FAULT"))
    chain = F
    for test, cause in causes:
        chain = chain.when(test, F.lit(cause))
    return chain.otherwise(F.lit("VIBRATION"))


def _reach_labels(marked: DataFrame, keys: Sequence[str], at: str, reach: int, name: str):
    """1 where ``_hit`` holds for a row of the same keys at (at + 1 .. at + reach), else 0.

    Cut the axis ``at`` into blocks as long as ``reach``.  The reach of a row then
    ends inside the next block, so it covers a hit exactly when the last hit of its
    own block lies after it or the first hit of the next block lies within reach.
    Per key and block only those two numbers are kept: an aggregate that combines
    before the shuffle, and no per-key sort however many rows a key holds.
    """
    block = F.floor(F.col(at) / reach)
    hits = marked.where("_hit").select(*keys, F.col(at).alias("_at"), block.alias("_block"))
    none = F.lit(None).cast("bigint")

    def spot(where: Column, last_here: Column, first_next: Column) -> Column:
        return F.struct(
            where.alias("_block"), last_here.alias("last_here"), first_next.alias("first_next")
        )

    here, next_to = F.col("_block"), F.col("_block") - 1
    spots = F.array(spot(here, F.col("_at"), none), spot(next_to, none, F.col("_at")))
    edges = (
        hits.select(*keys, F.inline(spots))
        .groupBy(*keys, "_block")
        .agg(F.max("last_here").alias("_last_here"), F.min("first_next").alias("_first_next"))
    )
    within = (F.col("_last_here") > F.col(at)) | (F.col("_first_next") <= F.col(at) + reach)
    return (
        marked.withColumn("_block", block)
        .join(edges, [*keys, "_block"], "left")
        .withColumn(name, F.when(within, F.lit(1)).otherwise(F.lit(0)))
        .drop("_hit", "_block", "_last_here", "_first_next")
    )


def label_future_fault(
    df: DataFrame,
    horizon_s: int = 300,
    name: str = "label_fault_next_5m",
    key: str = "machine_id",
    time: str = "event_time",
) -> DataFrame:
    """1 if the machine faults within the seconds (t + 1 .. t + horizon], else 0.

    Works on whole seconds: a fault in the same second does not count.
    """
    marked = df.withColumns({"_sec": F.unix_seconds(F.col(time)), "_hit": is_fault()})
    return _reach_labels(marked, [key], "_sec", horizon_s, name).select(*df.columns, name)


def label_next_rows(
    df: DataFrame,
    n: int,
    order: Sequence[str] = ("event_time",),
    name: str = "label_fault_next_5m",
    key: str = "machine_id",
    fault: Column | None = None,
    bucket_s: float = BUCKET_S,
) -> DataFrame:
    """1 if any of the machine's next ``n`` rows is a fault, else 0.

    ``order`` starts with the event time and must be total within a machine (add a
    tie-breaker).  The rows of a machine are cut into buckets of ``bucket_s`` seconds; a
    bucket's last ``n`` rows meet in one boundary row.
    """
    marked = df.withColumn("_hit", F.coalesce(is_fault() if fault is None else fault, F.lit(False)))
    found = hit_ahead(bucketed(marked, [key], order[0], bucket_s), [key], order, "_hit", max(1, n))
    return found.select(*df.columns, F.col("_near").cast("int").alias(name))


def change_points(
    polls: DataFrame, key: str, poll_time: str, value: str, bucket_s: float = BUCKET_S
) -> DataFrame:
    """The polls at which ``value`` differs from the previous non-null poll of the key.

    The first value of a key is the baseline and is not reported.  Adds ``lag_ms``,
    the age of the new value when it was first seen, to 0.1 ms.
    """
    seen = bucketed(polls.where(F.col(value).isNotNull()), [key], poll_time, bucket_s)
    lag_ms = (F.unix_micros(F.col(poll_time)) - F.unix_micros(F.col(value))) / F.lit(1000.0)
    found = changes(seen, [key], [poll_time, value], value)
    return found.withColumn("lag_ms", F.round(lag_ms, 1)).select(*polls.columns, "lag_ms")


def training_rows(
    silver: DataFrame,
    temp: float = TEMP_LIMIT,
    vib: float = VIBRATION_LIMIT,
    label_horizon_s: int = 300,
) -> DataFrame:
    """Labelled rows with the limits they were judged by, ready to export."""
    labelled = label_future_fault(silver, label_horizon_s)
    return labelled.withColumns(
        {
            "is_fault": F.coalesce(F.col("state") == "FAULT", F.lit(False)),
            "threshold_crossed": threshold_crossed(temp, vib),
            "temp_fault_threshold": F.lit(float(temp)),
            "vibration_fault_threshold": F.lit(float(vib)),
        }
    )


def fault_share(labelled: DataFrame, label: str = "label_fault_next_5m") -> DataFrame:
    """One row: rows and share of positive labels, to judge a training set."""
    return labelled.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(as_number(F.col(label) == 1)).alias("positive_share")
    )
