"""Joins whose row side may hold a third of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many is hot, so there are fewer hot keys than this.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has one row per key.

    ``weight`` is a column of ``lookup`` that says how many rows of ``rows`` the key has; it is
    dropped.  Keys with more than a 1,000th of all rows, fewer than 1,000 by that, are
    broadcast, so their rows stay where they are; the others are shuffled.  Both inputs are
    read more than once and should be stored; keys must not be null.
    """
    keys = list(keys)
    total = lookup.agg(F.sum(F.col(weight).cast("decimal(38,0)"))).first()[0] or 0
    is_hot = F.col(weight).cast("decimal(38,0)") * HOT_KEYS > F.lit(total)
    hot, cold = lookup.where(is_hot).drop(weight), lookup.where(~is_hot).drop(weight)
    if hot.isEmpty():
        return rows.join(cold, keys)
    found = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return found.unionByName(rest)
