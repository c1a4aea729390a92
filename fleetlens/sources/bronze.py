"""Device messages to bronze rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import iso_time
from fleetlens.schemas import BRONZE, NO_FAULT, PAYLOAD


def clear_fault(code: Column) -> Column:
    """NULL for every spelling of "no fault"."""
    return F.when(~code.isin(*NO_FAULT), code)


def parse_bronze(
    raw: DataFrame, ingest_time: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Broker rows (``value``, ``timestamp``) to bronze rows, batch or stream.

    A field of the wrong type becomes NULL; rows without a machine are dropped.
    ``ts`` is the device's own time, else the broker's.
    """
    arrival = F.col("timestamp").cast("timestamp")
    body = F.col("value").cast("string")
    # As a generator, so that the filter on its output cannot make Spark parse twice.
    fields = F.inline(F.array(F.from_json(body, PAYLOAD)))
    parsed = raw.select(
        fields,
        body.alias("raw_body"),
        iso_time(arrival).alias("iothub_enqueued_time"),
        iso_time(F.current_timestamp() if ingest_time is None else ingest_time).alias("ingest_ts"),
        *keep,
    ).where("machine_id is not null")
    return parsed.withColumns(
        {
            "fault_code": clear_fault(F.col("fault_code")),
            "ts": F.coalesce("ts", "iothub_enqueued_time"),
        }
    ).select(*BRONZE.names, *keep)


def with_body_check(raw: DataFrame) -> DataFrame:
    """Add ``well_formed``: the body is a complete JSON object."""
    body = F.col("value").cast("string")
    complete = F.try_parse_json(body).isNotNull() & F.ltrim(body).startswith("{")
    return raw.withColumn("well_formed", F.coalesce(complete, F.lit(False)))


def split_malformed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed messages and the rest; nothing is lost between the two."""
    checked = with_body_check(raw)
    good = checked.where("well_formed").drop("well_formed")
    quarantine = checked.where("not well_formed").drop("well_formed")
    return good, quarantine


def message_counters(raw: DataFrame) -> DataFrame:
    """One row: messages received, parsed, malformed, and parsed ones without a machine."""
    checked = with_body_check(raw).select(
        "well_formed",
        F.get_json_object(F.col("value").cast("string"), "$.machine_id").alias("machine_id"),
    )
    good = F.col("well_formed")
    return checked.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(good).alias("parsed"),
        F.count_if(~good).alias("malformed"),
        F.count_if(good & F.col("machine_id").isNull()).alias("without_machine"),
    )
