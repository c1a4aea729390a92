"""Checks around a run: outputs present, stream alive, mirror complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.expr import before, rows_since
from fleetlens.plans.semantic import AsOf
from fleetlens.schemas import ensure_table, missing_columns


class CheckFailed(RuntimeError):
    """A check found the data in a state the next step must not build on."""


def parity_check(
    left: DataFrame, right: DataFrame, key: str = "machine_id", event_time: str = "last_event_time"
) -> DataFrame:
    """One row comparing two copies: counts, newest times, keys missing on either side.

    Both copies go through one aggregate per key, so no join and no hot key.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias("k"), F.col(event_time).alias("t"), F.lit(name).alias("s"))

    in_left, in_right = F.col("s") == "l", F.col("s") == "r"
    per_key = (
        side(left, "l")
        .unionByName(side(right, "r"))
        .groupBy("k")
        .agg(
            F.count_if(in_left).alias("l"),
            F.count_if(in_right).alias("r"),
            F.max(F.when(in_left, F.col("t"))).alias("lt"),
            F.max(F.when(in_right, F.col("t"))).alias("rt"),
        )
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(
        total("l").alias("left_rows"),
        total("r").alias("right_rows"),
        F.max("lt").alias("left_latest"),
        F.max("rt").alias("right_latest"),
        F.count_if(F.col("r") == 0).alias("missing_right"),
        F.count_if(F.col("l") == 0).alias("missing_left"),
        (total("l") == total("r")).alias("counts_equal"),
    )


def _fingerprint(columns: Sequence[str]) -> Column:
    """A hash of a row that tells a null from any value, in every column."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def bucket_checksums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """``bucket, n, check``: rows and an order-independent checksum per hash bucket of the keys.

    The checksum adds up row hashes, so it can be kept with a table and compared without it.
    """
    row = _fingerprint(columns).cast("decimal(38,0)")
    return df.groupBy(_bucket(keys, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(row).alias("check")
    )


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(_fingerprint(keys), F.lit(buckets))


def unequal_buckets(left: DataFrame, right: DataFrame) -> list[int]:
    """Buckets of two :func:`bucket_checksums` that differ; at most as many as there are buckets."""
    there = left.select("bucket", "n", "check")
    other = right.select(F.col("bucket").alias("b"), F.col("n").alias("n2"), F.col("check").alias("c2"))
    met = there.join(other, there["bucket"] == other["b"], "full")
    same = F.col("n").eqNullSafe(F.col("n2")) & F.col("check").eqNullSafe(F.col("c2"))
    return sorted(r[0] for r in met.where(~same).select(F.coalesce("bucket", "b")).collect())


def parity_differences(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str] = "machine_id",
    columns: Sequence[str] | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Keys on which two copies differ: ``difference`` is missing_left, missing_right or unequal.

    Both copies are read once for checksums per bucket; rows are compared only in buckets whose
    checksums differ, in one aggregate per key.  A key with several rows is unequal when their
    numbers or contents differ.
    """
    keys = [key] if isinstance(key, str) else list(key)
    compared = [c for c in left.columns if c in right.columns] if columns is None else [*keys, *columns]
    sides = [df.select(*dict.fromkeys([*keys, *compared])) for df in (left, right)]
    odd = unequal_buckets(*[bucket_checksums(df, keys, compared, buckets) for df in sides])
    marked = [
        df.where(_bucket(keys, buckets).isin(odd) if odd else F.lit(False)).select(
            *keys, F.lit(name).alias("_side"), _fingerprint(compared).cast("decimal(38,0)").alias("_row")
        )
        for df, name in zip(sides, ("l", "r"))
    ]
    in_left, in_right = F.col("_side") == "l", F.col("_side") == "r"
    per_key = marked[0].unionByName(marked[1]).groupBy(*keys).agg(
        F.count_if(in_left).alias("left_rows"),
        F.count_if(in_right).alias("right_rows"),
        F.sum(F.when(in_left, F.col("_row"))).alias("_l"),
        F.sum(F.when(in_right, F.col("_row"))).alias("_r"),
    )
    kind = (
        F.when(F.col("right_rows") == 0, "missing_right")
        .when(F.col("left_rows") == 0, "missing_left")
        .when((F.col("left_rows") != F.col("right_rows")) | (F.col("_l") != F.col("_r")), "unequal")
    )
    return per_key.withColumn("difference", kind).where("difference is not null").drop("_l", "_r")


def require_parity(left: DataFrame, right: DataFrame, **kwargs) -> dict:
    found = parity_check(left, right, **kwargs).first().asDict()
    if not found["counts_equal"]:
        raise CheckFailed(f"row counts differ: {found['left_rows']} and {found['right_rows']}")
    return found


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per named table."""
    counted = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def validate_outputs(
    tables: Mapping[str, DataFrame],
    required: Sequence[str],
    optional: Sequence[str] = (),
    times: Mapping[str, str] | None = None,
) -> dict:
    """Fail when a required table is empty; report empty optional ones and newest times.

    An optional table may be empty, e.g. windows whose watermark has not passed yet.
    """
    counts = {r["table_name"]: r["row_count"] for r in table_counts(tables).collect()}
    empty = [name for name in required if not counts.get(name)]
    if empty:
        raise CheckFailed(f"no rows in {', '.join(empty)}")
    newest = {n: tables[n].agg(F.max(c)).first()[0] for n, c in (times or {}).items()}
    return {
        "counts": counts,
        "warnings": [n for n in optional if not counts.get(n)],
        "newest": newest,
    }


def recent_count(df: DataFrame, as_of: AsOf, minutes: int = 60, column: str = "event_time"):
    """One row: records of the last minutes."""
    recent = rows_since(df, column, before(as_of, minutes=minutes))
    return recent.agg(F.count(F.lit(1)).alias("records"))


def stream_health(
    df: DataFrame, as_of: AsOf, minutes: int = 60, minimum: int = 1000, column: str = "event_time"
) -> int:
    """Records of the last minutes; fails below ``minimum``."""
    found = recent_count(df, as_of, minutes, column).first()["records"]
    if found < minimum:
        raise CheckFailed(f"{found} records in the last {minutes} minutes, expected {minimum}")
    return found


def preflight(spark: SparkSession, table: str, schema: T.StructType) -> int:
    """Create or complete ``table`` and prove that it can be read; returns its rows."""
    ensure_table(spark, table, schema)
    stored = spark.table(table)
    if missing_columns(stored.columns, schema):
        raise CheckFailed(f"{table} lacks columns")
    return stored.count()
