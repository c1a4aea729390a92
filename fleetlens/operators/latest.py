"""Newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(columns: Sequence[str], order: Sequence[str], tiebreak: Sequence[str] = ()):
    """Aggregate: the row of ``columns`` that is greatest by ``order``, as a struct.

    The whole row is the sort key: ``order`` first, then ``tiebreak``, then the
    remaining columns, so equal times still give one definite answer.  Partial
    results are combined before the shuffle, so a hot key sends one row per task.
    NULL sorts lowest.
    """
    lead = [*order, *[c for c in tiebreak if c not in order]]
    return F.max(F.struct(*lead, *[c for c in columns if c not in lead]))


def latest_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` values."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(newest(rest, order, tiebreak).alias("_row"))
    return picked.select(*[c if c in keys else f"_row.`{c}`" for c in df.columns])


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that are absent from ``old`` or differ from it, with ``change``.

    Both sides hold one row per key; they meet in one aggregate instead of a join,
    which also compares NULLs as equal.
    """
    payload = [c for c in new.columns if c not in keys]
    row = F.struct(*payload)

    def side(df: DataFrame, flag: bool) -> DataFrame:
        return df.select(*keys, F.lit(flag).alias("_is_new"), row.alias("_row"))

    both = side(old, False).unionByName(side(new, True))
    before, after = (F.max(F.when(F.col("_is_new") == flag, F.col("_row"))) for flag in (False, True))
    met = both.groupBy(*keys).agg(before.alias("_before"), after.alias("_after"))
    return met.where("_after is not null and not (_before <=> _after)").select(
        *keys,
        *[f"_after.`{c}`" for c in payload],
        F.when(F.col("_before").isNull(), "insert").otherwise("update").alias("change"),
    )
