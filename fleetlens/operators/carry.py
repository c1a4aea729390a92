"""Row-order operators by segmented carry.

The rows of a key are cut into buckets of time.  Inside a bucket an ordinary window sees the
neighbours; what has to cross a bucket's edge is worked out on one boundary row per bucket.
Rows meet in one exchange by (key, bucket), so a key with a third of all rows is spread over
as many tasks as it has buckets, and nothing is numbered, checkpointed or copied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a bucket.  At one message a second this is a window of 3,600 rows.
BUCKET_S = 3600


def time_bucket(df: DataFrame, time: str, width_s: float = BUCKET_S) -> Column:
    """Number of the bucket a row falls into, rising with ``time`` (a time, or a number of seconds).

    Null times share the bucket null, which sorts first, as they do.
    """
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)
    elif isinstance(kind, T.DateType):
        seconds = F.unix_date(time) * F.lit(86_400.0)
    else:
        seconds = F.col(time).cast("double")
    return F.floor(seconds / F.lit(float(width_s)))


def bucketed(df: DataFrame, keys: Sequence[str], time: str, width_s: float = BUCKET_S) -> DataFrame:
    """``df`` with ``_cell``, its keys and bucket, and dealt by that: the one exchange of the rows.

    A struct, because structs compare null fields as equal: rows without key or time meet too.
    """
    cell = F.struct(*keys, time_bucket(df, time, width_s).alias("_bucket"))
    return df.withColumn("_cell", cell).repartition("_cell")


def _along(keys: Sequence[str], *order: Column):
    """Window over the boundary rows of a key."""
    return Window.partitionBy(*[F.col(f"_cell.`{k}`") for k in keys]).orderBy(*order)


def hit_ahead(marked: DataFrame, keys: Sequence[str], order: Sequence[str], hit: str, n: int) -> DataFrame:
    """``_near``: whether one of the next ``n`` rows of the row's keys has ``hit``.

    ``marked`` comes from :func:`bucketed`; ``order`` is a total order that starts with its time.
    Rows count from the end of a bucket, so the windows run from the end with frames that only
    grow.  All but the last ``n`` rows of a bucket find their answer inside it.  A boundary row
    holds those last ones, the rows of its bucket and the place of its first hit.  Both branches
    need the whole rows, so Spark reads one exchange twice instead of making two.
    """
    columns = [c for c in marked.columns if c != "_cell"]
    inside = Window.partitionBy("_cell").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    later = inside.rowsBetween(Window.unboundedPreceding, -1)
    counted = marked.withColumn("_place", F.row_number().over(inside).cast("bigint"))
    hit_place = F.when(F.col(hit), F.col("_place"))
    counted = counted.withColumn("_here", F.col("_place") - F.max(hit_place).over(later))
    tail = F.collect_list(F.when(F.col("_place") <= n, F.struct(*columns, "_place", "_here")))
    edges = counted.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(hit_place).alias("_first_hit"), tail.alias("_tail")
    )
    after = _along(keys, F.col("_cell._bucket").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_rows_after", F.coalesce(F.sum("_rows").over(after), F.lit(0)))
    next_hit = F.max(F.col("_rows_after") + F.col("_first_hit")).over(after)
    edges = edges.withColumn("_carry", F.col("_rows_after") - next_hit)
    edges = edges.select("_carry", F.inline("_tail"))
    ahead = F.coalesce(F.col("_here"), F.col("_place") + F.col("_carry"))

    def near(rows: DataFrame, distance: Column) -> DataFrame:
        return rows.select(*columns, F.coalesce(distance <= n, F.lit(False)).alias("_near"))

    return near(counted.where(F.col("_place") > n), F.col("_here")).unionByName(near(edges, ahead))


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The rows whose ``value`` differs from that of the row before; a key's first row is none.

    ``rows`` come from :func:`bucketed`.  A boundary row has the whole first row of a bucket and
    its last value, so a change at an edge is found, and given out, without touching the rows.
    """
    columns = [c for c in rows.columns if c != "_cell"]
    place = F.struct(*order, *[c for c in columns if c not in order])
    inside = Window.partitionBy("_cell").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    within = rows.withColumn("_before", F.lag(value).over(inside)).where(F.col(value) != F.col("_before"))
    edges = rows.groupBy("_cell").agg(
        F.min(place).alias("_first"), F.max(F.struct(*order, F.col(value).alias("_value"))).alias("_last")
    )
    along = _along(keys, F.col("_cell._bucket").asc_nulls_first())
    edges = edges.withColumn("_before", F.lag("_last._value").over(along))
    edges = edges.where(F.col(f"_first.`{value}`") != F.col("_before"))
    return within.select(*columns).unionByName(edges.select(*[F.col(f"_first.`{c}`").alias(c) for c in columns]))
