"""The streaming queries: each reads a stream, applies a batch operator, writes a sink.

Every job takes a checkpoint folder and a trigger (``{"availableNow": True}`` or
``{"processingTime": "1 second"}``) and returns the started ``StreamingQuery``.
Nothing is collected: a micro-batch that fails raises, and Spark replays it.
Rates are limited at the source (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

from fleetlens.operators.gold import machine_health_windows, status_windows, with_lag
from fleetlens.operators.latest import newest
from fleetlens.operators.partials import Partials
from fleetlens.operators.quality import RULES, Rule, observe_rules
from fleetlens.operators.scoring import rule_alerts
from fleetlens.operators.silver import silver_clean
from fleetlens.plans.semantic import AsOf
from fleetlens.session import pin
from fleetlens.sinks.keyed import KeyedTable
from fleetlens.sinks.layout import DATE, bloom_options, with_date
from fleetlens.sinks.retry import PartitionSink, write_partitions
from fleetlens.sources.bronze import parse_bronze

Trigger = dict
AVAILABLE_NOW: Trigger = {"availableNow": True}
EVERY_SECOND: Trigger = {"processingTime": "1 second"}
HEALTH_WATERMARK, STATUS_WATERMARK = "2 minutes", "10 seconds"


ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on executor disks instead of their heaps."""
    for name, value in ROCKSDB.items():
        spark.conf.set(name, value)


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None
) -> DataFrame:
    """A Parquet folder as a stream of its new files."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def append_files(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger,
    name: str | None = None,
    partition_by: tuple[str, ...] = (),
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Append a stream to Parquet files; ``options`` go to the Parquet writer."""
    writer = df.writeStream.format("parquet").outputMode("append").trigger(**trigger)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer = writer.queryName(name)
    with started_with(df.sparkSession, options or {}):
        return writer.option("path", path).option("checkpointLocation", checkpoint).start()


@contextmanager
def started_with(spark: SparkSession, options: dict[str, str]):
    """Session settings that a stream keeps from its start, as its file writer's or its state's."""
    before = {name: spark.conf.get(name, None) for name in options}
    for name, value in options.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def start_bronze(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
    ingest_time: Column | None = None,
    keep: tuple[str, ...] = (),
) -> StreamingQuery:
    """Broker messages to bronze files."""
    return append_files(parse_bronze(raw, ingest_time, keep), path, checkpoint, trigger)


def start_silver(
    bronze: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
    keep: tuple[str, ...] = (),
    rules: tuple[Rule, ...] = RULES,
    by_date: bool = True,
) -> StreamingQuery:
    """Bronze to silver; rule violations appear in the progress as ``row_quality``.

    ``by_date`` partitions the files by ``event_date``, which look-back reads prune on.  Files
    have Bloom filters on the machine; ``sinks.layout.settle`` rewrites closed dates in order.
    """
    silver = observe_rules(silver_clean(bronze, keep), "row_quality", rules)
    options = bloom_options()
    if not by_date:
        return append_files(silver, path, checkpoint, trigger, options=options)
    return append_files(with_date(silver), path, checkpoint, trigger, partition_by=(DATE,), options=options)


def health_stream(silver: DataFrame, watermark: str = HEALTH_WATERMARK, **kwargs) -> DataFrame:
    """Health windows of a stream; a window appears once the watermark passed its end."""
    return machine_health_windows(silver.withWatermark("event_time", watermark), **kwargs)


def status_stream(
    silver: DataFrame,
    watermark: str = STATUS_WATERMARK,
    window: str = "10 seconds",
    tiebreak: tuple[str, ...] = (),
    as_of: AsOf | None = None,
) -> DataFrame:
    """Newest reading per machine and short window of a stream, with its lag.

    The lag is taken against ``as_of``, without one against the time of the micro-batch.
    """
    newest_rows = status_windows(silver.withWatermark("event_time", watermark), window, tiebreak)
    return with_lag(newest_rows, F.current_timestamp() if as_of is None else as_of)


def start_health(
    silver: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
    watermark: str = HEALTH_WATERMARK,
    **kwargs,
) -> StreamingQuery:
    return append_files(health_stream(silver, watermark, **kwargs), path, checkpoint, trigger)


def start_status(
    silver: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
    watermark: str = STATUS_WATERMARK,
    tiebreak: tuple[str, ...] = (),
    as_of: AsOf | None = None,
) -> StreamingQuery:
    status = status_stream(silver, watermark, tiebreak=tiebreak, as_of=as_of)
    return append_files(status, path, checkpoint, trigger)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the query that owns a checkpoint; a new checkpoint gives a new one.

    Batch numbers start over with a new checkpoint, so they only identify a batch
    together with this.
    """
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def latest_stream(
    status: DataFrame, order: tuple[str, ...] = ("last_event_time",), tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """One row per machine, for update mode: late older rows never replace newer ones."""
    rest = [c for c in status.columns if c != "machine_id"]
    picked = status.groupBy("machine_id").agg(newest(rest, order, tiebreak).alias("_row"))
    return picked.select("machine_id", *[F.col(f"_row.`{c}`") for c in rest])


def start_latest(
    status: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
    order: tuple[str, ...] = ("last_event_time",),
    tiebreak: tuple[str, ...] = (),
    on_change: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep the newest row per machine in a keyed table at ``path``.

    Each micro-batch holds the machines whose newest row changed, which is the change
    feed: ``on_change`` receives the same rows (say, to mirror them) after the table
    has been published.  Replayed batches are recognised by their id.
    """
    table = KeyedTable(status.sparkSession, path, ("machine_id",), order)

    def publish(batch: DataFrame, batch_id: int) -> None:
        if on_change is not None:
            batch = pin(batch)
        table.upsert(batch, f"{query_id(table.spark, checkpoint)}-{batch_id}")
        table.compact()
        table.drop_old()
        if on_change is not None:
            on_change(batch, batch_id)

    return (
        latest_stream(status, order, tiebreak)
        .writeStream.outputMode("update")
        .trigger(**trigger)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .start()
    )


def start_alerts(
    silver: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
    detected_at: Column | None = None,
) -> StreamingQuery:
    """Events that break the alert rule, appended as they arrive."""
    now = F.current_timestamp() if detected_at is None else detected_at
    return append_files(rule_alerts(silver, now), path, checkpoint, trigger)


def start_to_sink(
    df: DataFrame,
    sink: PartitionSink,
    checkpoint: str,
    key: str,
    parts: int,
    trigger: Trigger = AVAILABLE_NOW,
    **kwargs,
) -> StreamingQuery:
    """A stream to a sink outside Spark, with tokens and retries per partition (``sinks.retry``)."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        write_partitions(batch, sink, f"{query_id(batch.sparkSession, checkpoint)}-{batch_id}", key, parts, **kwargs)

    return df.writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(publish).start()


# ---- late rows --------------------------------------------------------------------------------


def route_late(
    events: DataFrame,
    window: str = "5 minutes",
    watermark: str = HEALTH_WATERMARK,
    key: str = "machine_id",
    time: str = "event_time",
) -> DataFrame:
    """``events`` with ``late``: whether the window of the row had been published before it came.

    The state of a key is the time up to which its windows are published: the query's
    watermark, or what it was before a restart.  Nothing is dropped, so rows in are rows
    out; a window query over the rows that are not late, with the same watermark, drops none.
    """
    width_ms = seconds_of(window) * 1000
    # pandas has no null among longs and would round large ones; as text they pass unchanged.
    longs = [f.name for f in events.schema.fields if isinstance(f.dataType, T.LongType)]
    passed = events.withColumns({c: F.col(c).cast("string") for c in longs}) if longs else events
    schema = T.StructType([*passed.schema.fields, T.StructField("late", T.BooleanType())])

    def route(_, frames, state: GroupState):
        seen = state.get[0] if state.exists else 0
        published = max(seen, state.getCurrentWatermarkMs())
        state.update((published,))
        for rows in frames:
            at = rows[time].astype("datetime64[ms]").astype("int64")
            end = (at // width_ms + 1) * width_ms
            yield rows.assign(late=(end <= published) & rows[time].notna())

    marked = passed.withWatermark(time, watermark).groupBy(key)
    routed = marked.applyInPandasWithState(route, schema, "published long", "append", "NoTimeout")
    return routed.select(
        *[F.col(c).cast("bigint").alias(c) if c in longs else c for c in events.columns],
        F.coalesce("late", F.lit(False)).alias("late"),
    )


def seconds_of(interval: str) -> int:
    """Seconds of an interval such as ``5 minutes``."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def start_routed(
    events: DataFrame, path: str, checkpoint: str, trigger: Trigger = AVAILABLE_NOW, **kwargs
) -> StreamingQuery:
    """All events at ``path``, the late ones in a partition of their own (``late`` is 1 there, else 0)."""
    routed = route_late(events, **kwargs).withColumn("late", F.col("late").cast("int"))
    return append_files(routed, path, checkpoint, trigger, partition_by=("late",))


def start_partials(
    events: DataFrame,
    partials: Partials,
    path: str,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
    watermark: str = HEALTH_WATERMARK,
) -> StreamingQuery:
    """Keep the partial aggregates of a metric view up to date, a row per key once its bucket is closed.

    Late rows (:func:`route_late`) become partial rows of their own, ``partials.build(late)``,
    in a table of corrections that the reader adds.
    """
    built = partials.build(events.withWatermark(partials.time, watermark))
    return append_files(built, path, checkpoint, trigger)


class LateCounter(StreamingQueryListener):
    """Counts what stateful operators drop because it came after the watermark.

    Every progress report is added up, however many there are; they arrive shortly after their
    batch.  Spark counts what reaches the operator, so an aggregate reports late groups of a
    batch (rows it has already combined), not rows: :func:`route_late` tells the rows.
    ``with LateCounter(spark) as late: ...; late.dropped(query)``.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._dropped: dict[str, int] = {}
        self._batches: dict[str, int] = {}

    def __enter__(self) -> LateCounter:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)

    def dropped(self, query: StreamingQuery) -> int:
        """Late rows or groups dropped since the counter began, over all runs of the query."""
        return self._dropped.get(str(query.id), 0)

    def batches(self, query: StreamingQuery) -> int:
        return self._batches.get(str(query.id), 0)

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names of the interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        query = str(event.progress.id)
        late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        self._dropped[query] = self._dropped.get(query, 0) + late
        self._batches[query] = self._batches.get(query, 0) + 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
