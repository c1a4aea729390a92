"""The frames the named queries share, derived from the test tables on first use."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import fixture
from fleetlens.functions.expr import as_number, clamp, instant
from fleetlens.operators import gold, scoring
from fleetlens.operators.silver import silver_clean
from fleetlens.plans import semantic
from fleetlens.schemas import SERVICE_REQUESTS, align_schema
from fleetlens.session import prepare, shared_dir, stored
from fleetlens.streaming import jobs

TIE = ("event_id",)
NUDGE = 1e-9
_AS_OF: dict[tuple, int] = {}


class Frames:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def fx(self) -> DataFrame:
        return fixture.telemetry(self.table("events"))

    @cached_property
    def raw(self) -> DataFrame:
        return fixture.raw_messages(self.fx)

    @cached_property
    def bronze(self) -> DataFrame:
        return fixture.bronze(self.fx, text=False)

    @cached_property
    def bronze_text(self) -> DataFrame:
        return fixture.bronze(self.fx)

    @cached_property
    def silver(self) -> DataFrame:
        return silver_clean(self.bronze, TIE)

    @property
    def as_of(self) -> int:
        """Newest event time in microseconds, the "now" of every query; found again when the file changes."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/events.parquet")
        status = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path)
        key = (self.sf_dir, status.getModificationTime(), status.getLen())
        if key not in _AS_OF:
            _AS_OF[key] = self.silver.agg(F.unix_micros(F.max("event_time"))).first()[0]
        return _AS_OF[key]

    @cached_property
    def gold(self) -> DataFrame:
        return gold.machine_health_windows(self.silver)

    @cached_property
    def status10(self) -> DataFrame:
        return gold.with_lag(gold.status_windows(self.silver, tiebreak=TIE), self.as_of)

    @cached_property
    def latest(self) -> DataFrame:
        return semantic.latest_readings(self.status10, TIE)

    @cached_property
    def scorable(self) -> DataFrame:
        """All events with a stand-in decision value."""
        raw = (F.lit(60.0) - F.col("temp_c")) / F.lit(40.0)
        return self.silver.withColumn("raw", raw).withColumn("inference_type", F.lit("batch"))

    @cached_property
    def anomaly(self) -> DataFrame:
        return scoring.anomaly_rows(self.scorable, "fixture", instant(self.as_of), keep=TIE)

    @cached_property
    def fault(self) -> DataFrame:
        blended = scoring.blend_score(self.scorable)
        prob = clamp(
            F.col("anomaly_score") * F.lit(0.9)
            + as_number(F.col("state") == "FAULT") * F.lit(0.1),
            0,
            1,
        )
        return scoring.prediction_rows(
            blended.withColumn("prob", prob), "fixture", instant(self.as_of), keep=TIE
        )

    @cached_property
    def dim(self) -> DataFrame:
        """Stored, so that joins of whole event tables know how large it is."""
        return stored(semantic.dim_machine(self.silver))

    @cached_property
    def health(self) -> DataFrame:
        return semantic.machine_health(self.gold, self.anomaly, self.fault, tiebreak=TIE)

    @cached_property
    def status(self) -> DataFrame:
        newest = semantic.machine_health(
            semantic.latest_windows(self.gold), self.anomaly, self.fault, tiebreak=TIE
        )
        # The machines of the status windows are those of silver; Spark reuses their shuffle.
        dim = semantic.dim_machine(self.latest)
        return semantic.current_status(self.status10, newest, dim, self.as_of, TIE)

    @cached_property
    def latency(self) -> DataFrame:
        return semantic.hop_latency(self.bronze)

    @cached_property
    def mirror(self) -> DataFrame:
        """A stale copy of the latest status: it was taken 60 s before the newest event."""
        taken = (F.unix_micros("event_time") + 60_000_000) <= self.as_of
        past = gold.status_windows(self.silver.where(taken), tiebreak=TIE)
        return semantic.latest_readings(gold.with_lag(past, self.as_of), TIE)

    @cached_property
    def requests(self) -> DataFrame:
        """Service requests out of orders."""
        types = F.array(*[F.lit(t) for t in ("PREVENTIVE", "CORRECTIVE", "INSPECTION", "CALIBRATION")])
        priority = F.create_map(
            *[
                F.lit(x)
                for x in (
                    "1-URGENT", "CRITICAL", "2-HIGH", "HIGH", "3-MEDIUM", "MEDIUM",
                    "4-NOT SPECIFIED", "MEDIUM", "5-LOW", "LOW",
                )
            ]
        )
        status = F.create_map(*[F.lit(x) for x in ("O", "OPEN", "P", "IN_PROGRESS", "F", "RESOLVED")])
        made = F.col("o_orderdate").cast("timestamp")
        number = F.lpad((F.col("o_custkey") % 20).cast("string"), 4, "0")
        rows = self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.concat(F.lit("MC-"), number).alias("machine_id"),
            F.try_element_at(priority, F.col("o_orderpriority")).alias("priority"),
            F.get(types, (F.col("o_orderkey") % 4).cast("int")).alias("request_type"),
            F.try_element_at(status, F.col("o_orderstatus")).alias("status"),
            made.alias("created_at"),
            made.alias("updated_at"),
        )
        return align_schema(rows, SERVICE_REQUESTS)

    # ---- streams ----------------------------------------------------------------------

    def work_dir(self) -> str:
        return f"{shared_dir(self.spark)}/fleetlens-{uuid.uuid4().hex}"

    @property
    def event_stream(self) -> DataFrame:
        # A pattern, because a stream cannot name a single file as its folder.
        return jobs.stream_table(
            self.spark, f"{self.sf_dir}/event[s].parquet", fixture.EVENTS_SCHEMA
        )

    @property
    def silver_stream(self) -> DataFrame:
        return silver_clean(fixture.bronze(fixture.telemetry(self.event_stream), text=False), TIE)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits and times without a zone, so that engines compare equal."""
    shaped = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "double":
            # The nudge keeps sums that differ in their last bit (order of addition)
            # from landing on different sides of a rounding edge; the SQL has it too.
            shaped.append(f"round(`{field.name}` + {NUDGE}D, 6) as `{field.name}`")
        elif kind == "timestamp":
            shaped.append(f"cast(`{field.name}` as timestamp_ntz) as `{field.name}`")
        else:
            shaped.append(f"`{field.name}`")
    return df.selectExpr(*shaped)
