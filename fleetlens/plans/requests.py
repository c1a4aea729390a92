"""Service requests: creation, status changes, lists and counts as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.reports import in_lists, top_n
from fleetlens.plans.semantic import AsOf
from fleetlens.functions.expr import instant
from fleetlens.schemas import SERVICE_REQUESTS, align_schema

# Words of the service-request contract, in display order.
STATUSES = ("OPEN", "IN_PROGRESS", "RESOLVED", "CANCELLED")
CLOSED_WORDS = ("CLOSED", "RESOLVED")
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
REQUEST_TYPES = ("PREVENTIVE", "CORRECTIVE", "INSPECTION", "CALIBRATION")
SORTS = {
    "newest": ["-created_at"],
    "oldest": ["created_at"],
    "priority": ["priority_rank"],
}


def sr_create(requests: DataFrame, batch_id: str, created_at: AsOf) -> DataFrame:
    """New requests ready to append: one row per machine of the frame.

    A single request gets the batch id, several get ``batch-0``, ``batch-1``, …
    ``requests`` needs machine_id, priority, request_type, description, requestor and,
    for more than one row, ``position`` (0-based).
    """
    now = instant(created_at)
    if "position" in requests.columns:
        identity = F.concat(F.lit(f"{batch_id}-"), F.col("position").cast("string"))
    else:
        identity = F.lit(batch_id)
    filled = requests.withColumns(
        {"id": identity, "status": F.lit("OPEN"), "created_at": now, "updated_at": now}
    )
    return align_schema(filled, SERVICE_REQUESTS)


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Requests with a malformed machine id or an unknown type, with the reason."""
    reason = F.when(
        ~F.coalesce(F.col("machine_id").rlike(r"^MC-\d{4}$"), F.lit(False)), "machine_id"
    ).when(~F.coalesce(F.col("request_type").isin(*REQUEST_TYPES), F.lit(False)), "request_type")
    return requests.withColumn("reason", reason).where("reason is not null")


def sr_apply_status(requests: DataFrame, changes: DataFrame, updated_at: AsOf) -> DataFrame:
    """The requests named in ``changes`` (id, status) with their new status, to upsert.

    Requests without a change are not returned; changes to unknown ids have no effect.
    """
    wanted = changes.select("id", F.col("status").alias("_status"))
    return (
        requests.join(wanted, "id")
        .withColumns({"status": F.col("_status"), "updated_at": instant(updated_at)})
        .select(*requests.columns)
    )


def sr_filter(
    requests: DataFrame,
    statuses: Sequence[str] = (),
    priorities: Sequence[str] = (),
    machines: Sequence[str] = (),
    types: Sequence[str] = (),
) -> DataFrame:
    return in_lists(
        requests, status=statuses, priority=priorities, machine_id=machines, request_type=types
    )


def sr_list(
    requests: DataFrame,
    statuses: Sequence[str] = (),
    priorities: Sequence[str] = (),
    machines: Sequence[str] = (),
    limit: int = 5000,
    sort: str = "newest",
) -> DataFrame:
    """The newest matching requests; see :func:`sr_total` for how many match in all."""
    return sr_sorted(sr_filter(requests, statuses, priorities, machines), sort, limit)


def sr_sorted(requests: DataFrame, sort: str = "newest", limit: int | None = None) -> DataFrame:
    """Sorted ``newest``, ``oldest`` or by ``priority`` (most urgent first)."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    ranked = requests.withColumn("priority_rank", F.nullif(rank, F.lit(0)) - 1)
    terms = SORTS[sort]
    if sort == "priority":
        # Unknown priorities go last.
        ranked = ranked.withColumn(
            "priority_rank", F.coalesce("priority_rank", F.lit(len(PRIORITIES)))
        )
    return top_n(ranked, terms, limit, ["id"]).drop("priority_rank")


def sr_total(requests: DataFrame, **filters: Sequence[str]) -> DataFrame:
    return sr_filter(requests, **filters).agg(F.count(F.lit(1)).alias("total_count"))


def sr_status_counts(requests: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Requests per listed status, 0 when there are none; other words are left out."""
    listed = requests.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counted = requests.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counted, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("requests")
    )
