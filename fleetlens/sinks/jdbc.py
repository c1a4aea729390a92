"""Mirror of the current status in an operational database.

Executors write the rows to a staging table over JDBC; one statement inside the
database then merges staging into the target.  No row passes through the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.expr import count_if
from fleetlens.schemas import MIRROR_STATUS, align_schema

# Tables and indexes of the mirror.
_STATUS_TYPES = {
    "string": "TEXT",
    "double": "DOUBLE PRECISION",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "timestamp": "TIMESTAMPTZ",
}


def mirror_ddl() -> list[str]:
    """Statements that create the mirror's tables and indexes when absent."""
    status = [f"{f.name} {_STATUS_TYPES[f.dataType.simpleString()]}" for f in MIRROR_STATUS.fields]
    status[0] += " PRIMARY KEY"
    status += ["source_watermark TIMESTAMPTZ", "updated_at TIMESTAMPTZ DEFAULT CURRENT_TIMESTAMP"]
    tables = {
        "machine_current_status": status,
        "mirror_metadata": [
            "instance_id TEXT PRIMARY KEY",
            "last_run_at TIMESTAMPTZ",
            "row_count BIGINT",
            "source_watermark TIMESTAMPTZ",
            "execution_time_seconds DOUBLE PRECISION",
            "status TEXT",
        ],
        "dim_machine": ["machine_id TEXT PRIMARY KEY", "line_name TEXT"],
        "service_requests": [
            "id TEXT PRIMARY KEY",
            "machine_id TEXT NOT NULL",
            "priority TEXT NOT NULL",
            "request_type TEXT NOT NULL",
            "description TEXT",
            "requestor TEXT",
            "status TEXT NOT NULL DEFAULT 'OPEN'",
            "created_at TIMESTAMPTZ NOT NULL DEFAULT CURRENT_TIMESTAMP",
            "updated_at TIMESTAMPTZ NOT NULL DEFAULT CURRENT_TIMESTAMP",
        ],
    }
    indexes = {
        "idx_machine_status_event_time": "machine_current_status (last_event_time DESC)",
        "idx_service_requests_status": "service_requests (status, created_at DESC)",
    }
    made = [f"CREATE TABLE IF NOT EXISTS {t} ({', '.join(cols)})" for t, cols in tables.items()]
    return made + [f"CREATE INDEX IF NOT EXISTS {i} ON {on}" for i, on in indexes.items()]


def merge_statement(
    table: str,
    staging: str,
    keys: Sequence[str],
    columns: Sequence[str],
    dialect: str = "postgresql",
    touch: str | None = "updated_at",
    newer: str | None = None,
    computed: Mapping[str, str] | None = None,
) -> str:
    """Insert-or-update of ``columns`` from ``staging``; ``touch`` gets the current time.

    With ``newer``, a stored row whose value of that column is greater stays as it is.
    ``computed`` are further columns and the SQL expression they are filled with.
    """
    more = dict(computed or {})
    rest = [*[c for c in columns if c not in keys], *more]
    if dialect == "postgresql":
        sets = [f"{c} = EXCLUDED.{c}" for c in rest]
        if touch:
            sets.append(f"{touch} = CURRENT_TIMESTAMP")
        guard = f" WHERE {table}.{newer} IS NULL OR EXCLUDED.{newer} >= {table}.{newer}" if newer else ""
        return (
            f"INSERT INTO {table} ({', '.join([*columns, *more])}) "
            f"SELECT {', '.join([*columns, *more.values()])} FROM {staging} "
            f"ON CONFLICT ({', '.join(keys)}) DO UPDATE SET {', '.join(sets)}{guard}"
        )
    if dialect != "ansi":
        raise ValueError("dialect must be 'postgresql' or 'ansi'")
    match = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    values = {c: f"s.{c}" for c in columns} | more
    if touch:
        values[touch] = "CURRENT_TIMESTAMP"
    sets = [f"{c} = {v}" for c, v in values.items() if c not in keys]
    guard = f" AND (t.{newer} IS NULL OR s.{newer} >= t.{newer})" if newer else ""
    return (
        f"MERGE INTO {table} t USING {staging} s ON {match} "
        f"WHEN MATCHED{guard} THEN UPDATE SET {', '.join(sets)} "
        f"WHEN NOT MATCHED THEN INSERT ({', '.join(values)}) VALUES ({', '.join(values.values())})"
    )


def _is_valid():
    named = F.col("machine_id").isNotNull() & (F.col("machine_id") != "")
    return named & F.col("last_event_time").isNotNull()


def valid_mirror_rows(df: DataFrame) -> DataFrame:
    """Rows with a machine id and a last event time."""
    return df.where(_is_valid())


def _figures() -> list[Column]:
    """Rows, valid rows, invalid rows and the newest valid event time."""
    valid = F.coalesce(_is_valid(), F.lit(False))
    return [
        F.count(F.lit(1)).alias("row_count"),
        count_if(valid).alias("valid_rows"),
        count_if(~valid).alias("invalid_rows"),
        F.max(F.when(valid, F.col("last_event_time"))).alias("source_watermark"),
    ]


def mirror_counts(df: DataFrame) -> DataFrame:
    """One row: rows, valid rows, invalid rows and the newest valid event time."""
    return df.agg(*_figures())


def mirror_rows(status: DataFrame) -> DataFrame:
    """The mirrored columns of the valid rows."""
    return align_schema(valid_mirror_rows(status), MIRROR_STATUS)


def jdbc_writer(url: str, properties: dict[str, str]) -> Callable[[DataFrame, str], None]:
    """Writes a frame to a staging table from the executors, in batches."""

    def write(df: DataFrame, table: str) -> None:
        options = {"url": url, "dbtable": table, "batchsize": "10000", "truncate": "true"}
        df.write.format("jdbc").options(**options, **properties).mode("overwrite").save()

    return write


def jdbc_executor(
    spark: SparkSession, url: str, properties: dict[str, str]
) -> Callable[[Sequence[str]], None]:
    """Runs statements in one transaction through the JDBC driver on the class path."""

    def execute(statements: Sequence[str]) -> None:
        jvm = spark._jvm
        settings = jvm.java.util.Properties()
        for name, value in properties.items():
            settings.setProperty(name, value)
        connection = jvm.java.sql.DriverManager.getConnection(url, settings)
        try:
            connection.setAutoCommit(False)
            for text in statements:
                statement = connection.createStatement()
                statement.execute(text)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    return execute


def bulk_load(
    df: DataFrame, table: str, write: Callable[[DataFrame, str], None], writers: int
) -> None:
    """Load a large frame with a bounded number of database connections.

    A shuffle, not a coalesce, so that only the writing is limited to ``writers`` tasks.
    """
    write(df.repartition(writers), table)


def upsert_jdbc(
    status: DataFrame,
    write: Callable[[DataFrame, str], None],
    execute: Callable[[Sequence[str]], None],
    table: str = "machine_current_status",
    instance_id: str = "default",
    dialect: str = "postgresql",
    dim: DataFrame | None = None,
    dry_run: bool = False,
) -> dict:
    """Mirror ``status`` (one row per machine) and record the run; returns its counts.

    ``status`` is evaluated once: the staging write itself is observed, so counts and watermark
    are those of the rows it wrote, whatever the source does meanwhile.  The merge keeps stored
    rows that are newer.  The run is recorded after the merge, with the time it took.
    ``write`` and ``execute`` come from :func:`jdbc_writer` and :func:`jdbc_executor`.
    With ``dry_run`` the rows are only counted and validated.
    """
    started = time.monotonic()
    if dry_run:
        return mirror_counts(status).first().asDict() | {"written": False}
    seen = Observation(f"mirror of {table}")
    rows = mirror_rows(status.observe(seen, *_figures()))
    staging = f"{table}_staging"
    write(rows, staging)
    counts = dict(seen.get)
    if counts["valid_rows"] == 0:
        return counts | {"written": False}
    spark = rows.sparkSession
    run = spark.range(1).select(
        F.lit(instance_id).alias("instance_id"),
        F.current_timestamp().alias("last_run_at"),
        F.lit(counts["valid_rows"]).cast("bigint").alias("row_count"),
        F.lit(counts["source_watermark"]).cast("timestamp").alias("source_watermark"),
    )
    write(run, "mirror_metadata_staging")
    mark = {"source_watermark": "(SELECT MAX(source_watermark) FROM mirror_metadata_staging)"}
    statements = [
        merge_statement(table, staging, ["machine_id"], rows.columns, dialect, newer="last_event_time", computed=mark)
    ]
    if dim is not None:
        write(dim.select("machine_id", "line_name"), "dim_machine_staging")
        columns = ["machine_id", "line_name"]
        statements.append(
            merge_statement(
                "dim_machine", "dim_machine_staging", ["machine_id"], columns, dialect, touch=None
            )
        )
    execute(statements)
    done = {"execution_time_seconds": f"{time.monotonic() - started:.3f}", "status": "'SUCCESS'"}
    execute(
        [
            merge_statement(
                "mirror_metadata", "mirror_metadata_staging", ["instance_id"], run.columns, dialect, touch=None, computed=done
            )
        ]
    )
    return counts | {"written": True}
