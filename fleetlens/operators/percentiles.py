"""Exact percentiles and order statistics for groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import stored

STEP = 4096  # width of the value ranges whose counts are summed first
SAMPLE = "sample"


def histogram(df: DataFrame, by: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Rows per (group, metric, value).

    Integer milliseconds repeat a lot, so the counts combine before the shuffle and
    the shuffle key includes the value: a hot group is spread over many tasks.
    """
    metrics = [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()]
    return (
        df.select(*by, F.inline(F.array(*metrics)))
        .where("value is not null")
        .groupBy(*by, "metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sample_metric() -> dict[str, Column]:
    """A constant metric: its count is the number of rows, also of rows with NULL values."""
    return {SAMPLE: F.lit(1).cast("bigint")}


def samples() -> Column:
    """Rows behind a histogram that has the :func:`sample_metric`."""
    return F.coalesce(F.sum(F.when(F.col("metric") == SAMPLE, F.col("n"))), F.lit(0))


def weighted(metric: str) -> dict[str, Column]:
    """Aggregates of one metric over :func:`histogram` rows."""
    mine = F.col("metric") == metric
    value, n = F.when(mine, F.col("value")), F.when(mine, F.col("n"))
    return {"avg": F.sum(value * n) / F.sum(n), "min": F.min(value), "max": F.max(value)}


def values_at(
    counted: DataFrame, by: Sequence[str], picks: Sequence[tuple[str, str, Callable[[Column], Column]]]
) -> DataFrame:
    """Values at given positions of each group's sorted values, from :func:`histogram` rows.

    ``picks`` are ``(metric, name, position)``; ``position`` turns the number of values
    into a position from 0.  The result has ``metric`` = ``metric@name``, the ``value``
    there, and the number of values as ``n``.

    Equal values are one row, and running sums go in two steps: over ranges of ``STEP``
    milliseconds, then over the values of the ranges that hold a position.  A task
    therefore sorts at most the ranges of a group, or the ``STEP`` values of a range.
    """
    groups = [*by, "metric"]
    step = F.floor(F.col("value") / STEP).alias("_step")
    ranges = counted.groupBy(*groups, step).agg(F.sum("n").alias("_rows"))
    ranges = ranges.withColumns(
        {
            "_end": F.sum("_rows").over(Window.partitionBy(*groups).orderBy("_step")),
            "_total": F.sum("_rows").over(Window.partitionBy(*groups)),
        }
    )
    wanted = [
        F.struct(
            F.lit(metric).alias("_of"),
            F.lit(f"{metric}@{name}").alias("_pick"),
            position(F.col("_total")).cast("bigint").alias("_at"),
        )
        for metric, name, position in picks
    ]
    spots = ranges.select("*", F.inline(F.array(*wanted)))
    spots = spots.where("_of = metric and _at >= _end - _rows and _at < _end").select(
        *[F.col(c).alias(f"_{c}") for c in groups],
        F.col("_step").alias("_in"),
        "_pick",
        "_total",
        (F.col("_at") - F.col("_end") + F.col("_rows")).alias("_rest"),
    )
    inside = counted.select("*", step)
    same = F.col("_step") == F.col("_in")
    for c in groups:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    near = inside.join(spots, same)
    end = F.sum("n").over(Window.partitionBy(*groups, "_pick").orderBy("value"))
    return near.withColumn("_end", end).where("_rest >= _end - n and _rest < _end").select(
        *by, F.col("_pick").alias("metric"), "value", F.col("_total").alias("n")
    )


def _between(q: float, rounding: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda n: rounding(F.lit(float(q)) * (n - 1))


def with_percentiles(counted: DataFrame, by: Sequence[str], asked: Mapping[str, Sequence[float]]) -> DataFrame:
    """:func:`histogram` rows and, as further metrics, the values their percentiles lie between.

    The counts are stored, since they are needed three times and far fewer than the rows.
    """
    picks, counted = [], stored(counted)
    for metric, qs in asked.items():
        for q in dict.fromkeys(qs):
            picks += [(metric, f"{q}low", _between(q, F.floor)), (metric, f"{q}high", _between(q, F.ceil))]
    return counted.unionByName(values_at(counted, by, picks)) if picks else counted


def weighted_percentiles(metric: str, qs: Sequence[float]) -> Column:
    """Array of exact, linearly interpolated percentiles over :func:`with_percentiles` rows."""

    def at(name: str, column: str) -> Column:
        return F.max(F.when(F.col("metric") == f"{metric}@{name}", F.col(column)))

    def percentile(q: float) -> Column:
        low, high = at(f"{q}low", "value").cast("double"), at(f"{q}high", "value").cast("double")
        place = F.lit(float(q)) * (at(f"{q}low", "n") - 1)
        return low + (high - low) * (place - F.floor(place))

    return F.array(*[percentile(q) for q in qs])


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, picks: Mapping[str, float]
) -> DataFrame:
    """Per group the values at position ``int(n * q)`` (last row at most) of the sorted values."""
    return ranked_values(stored(histogram(df, by, {"v": F.col(value)})), by, picks)


def ranked_values(counted: DataFrame, by: Sequence[str], picks: Mapping[str, float]) -> DataFrame:
    """:func:`order_statistics` of the metric ``v`` of :func:`histogram` rows."""

    def position(q: float) -> Callable[[Column], Column]:
        return lambda n: F.least((n * F.lit(q)).cast("bigint"), n - 1)

    found = values_at(counted, by, [("v", name, position(q)) for name, q in picks.items()])
    return found.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == f"v@{name}", F.col("value"))).alias(name) for name in picks]
    )


def exact_value_at(df: DataFrame, value: str, position: Callable[[int], int], bins: int = 1024) -> float | None:
    """The double at a position (from 0) of the sorted values of ``df``; None without values.

    The range that holds the position is cut into ``bins`` and counted until one value is left,
    so each pass is one aggregate over the rows of the range, of at most ``bins`` groups, and the
    result is a value of the data, not an approximation.  NaN is left out.  Reads ``df`` a few times.
    """
    v = F.col(value).cast("double")
    usable = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    finite = F.abs("v") < float("inf")
    n, below, inside, low, high = usable.agg(
        F.count("v"),
        F.count_if(F.col("v") == float("-inf")),
        F.count_if(finite),
        F.min(F.when(finite, F.col("v"))),
        F.max(F.when(finite, F.col("v"))),
    ).first()
    if not n:
        return None
    rank = min(max(position(n), 0), n - 1) - below
    if not 0 <= rank < inside:
        return float("-inf") if rank < 0 else float("inf")
    while low < high:
        width = high / bins - low / bins
        slot = F.floor((F.col("v") - F.lit(low)) / F.lit(width)) if width > 0 else F.lit(0)
        slot = F.least(F.greatest(slot, F.lit(0)), F.lit(bins - 1)).cast("int")
        within = usable.where(F.col("v").between(low, high))
        found = within.groupBy(slot.alias("slot")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for part in sorted(found.collect(), key=lambda r: r.low):
            if rank < part.n:
                break
            rank -= part.n
        if (part.low, part.high) == (low, high):
            # The width of a bin is below the smallest double, so there are few values: count them.
            for same in sorted(within.groupBy("v").count().collect()):
                if rank < same["count"]:
                    return same["v"]
                rank -= same["count"]
        low, high = part.low, part.high
    return low


def probe_stats(samples: DataFrame, by: Sequence[str], value: str = "lag_ms") -> DataFrame:
    """Samples, min, p50, mean, p95, max and sample deviation per group, from one pass over the samples.

    That pass counts equal values; the counts are stored and everything else is worked out of them.
    """
    counted = stored(histogram(samples, by, {"v": F.col(value)}))
    n, v = F.col("n"), F.col("value")
    plain = counted.groupBy(*by).agg(
        F.sum("n").alias("samples"),
        F.min("value").alias("min_ms"),
        (F.sum(v * n) / F.sum("n")).alias("mean_ms"),
        F.max("value").alias("max_ms"),
    )
    ranked = ranked_values(counted, by, {"p50_ms": 0.5, "p95_ms": 0.95})
    # The squares are of distances from the mean, so they do not cancel.
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    mine = plain.select(*[F.col(c).alias(f"_{c}") for c in by], "mean_ms", "samples")
    spread = counted.join(mine, reduce(Column.__and__, same)) if by else counted.crossJoin(mine)
    squares = spread.groupBy(*by).agg(
        F.when(F.max("samples") > 1, F.sqrt(F.sum((v - F.col("mean_ms")) ** 2 * n) / (F.max("samples") - 1))).alias("stdev_ms")
    )
    if not by:
        return plain.crossJoin(squares).crossJoin(ranked)
    return plain.join(squares, list(by)).join(ranked, list(by))
