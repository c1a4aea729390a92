"""Small column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"  # fixed value: stored text form of a time


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` limited to [low, high]; NULL stays NULL.

    ``greatest`` and ``least`` skip NULLs, so without the test a missing sensor
    would read as the upper limit.
    """
    limited = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), limited)


def at_most(value: Column, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(float(high))))


def at_least(value: Column, low: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(low))))


def parse_time(text: Column) -> Column:
    """Text to timestamp, NULL for text that is not a time (ANSI mode would throw)."""
    return F.try_to_timestamp(text)


def as_time(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a time: parsed when it is text, as it is otherwise."""
    return parse_time(F.col(name)) if df.schema[name].dataType == T.StringType() else F.col(name)


def iso_time(instant: Column) -> Column:
    return F.date_format(instant, ISO_MILLIS)


def instant(value: Column | datetime | str | int) -> Column:
    """An ``as_of`` argument as a timestamp column; an int counts microseconds."""
    if isinstance(value, Column):
        return value
    if isinstance(value, int):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast("timestamp")


def before(as_of: Column | datetime | str | int, **parts: int) -> Column:
    """``as_of`` minus an interval, e.g. ``before(as_of, hours=24)``."""
    seconds = parts.get("seconds", 0) + 60 * parts.get("minutes", 0)
    span = F.make_dt_interval(
        F.lit(parts.get("days", 0)), F.lit(parts.get("hours", 0)), F.lit(0), F.lit(float(seconds))
    )
    return instant(as_of) - span


def rows_since(df: DataFrame, column: str, bound: Column) -> DataFrame:
    """Rows at or after ``bound``; prunes partitions when the table has ``event_date``."""
    if column == "event_time" and "event_date" in df.columns:
        df = df.where(F.col("event_date") >= F.to_date(bound))
    return df.where(F.col(column) >= bound)


def lag_seconds(earlier: Column, later: Column) -> Column:
    """Whole seconds from ``earlier`` to ``later``, both cut to the second first."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def lag_millis(earlier: Column, later: Column) -> Column:
    return F.unix_millis(later) - F.unix_millis(earlier)


def is_fault(state: str = "state", code: str = "fault_code") -> Column:
    """True when the machine reports the fault state or any fault code; never NULL."""
    return F.coalesce(F.col(state) == "FAULT", F.lit(False)) | F.col(code).isNotNull()


def as_number(flag: Column) -> Column:
    """1.0 when true, 0.0 when false or NULL."""
    return F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))


def count_if(flag: Column) -> Column:
    """Rows for which ``flag`` is true, 0 for none."""
    return F.count(F.when(flag, F.lit(1)))
