"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The JVM does not compile methods over 8,000 bytes of bytecode (HotSpot default).
COMPILED_METHOD_BYTES = 8000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators assume.

    Event times are UTC instants, so date functions must not shift them.  Stages over
    wide rows generate methods the JVM would only interpret; below the limit Spark
    splits them into methods that do get compiled (about 3x on the silver projection).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder: on a cluster another executor could not
    read it back after a loss.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="fleetlens-")
    sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint the copy is columnar and has file statistics, so Spark knows its
    size before it plans a join: a small lookup table is broadcast, a large one is not.
    """
    path = f"{shared_dir(df.sparkSession)}/fleetlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the copy.

    Used where a result must be read twice and be the same both times (row
    positions after a range sort, rows of a micro-batch going to two sinks).
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_FIXED_BYTES = {
    "boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 4,
    "timestamp": 8, "timestamp_ntz": 8, "void": 1,
}


def _value_bytes(value: Column, kind: T.DataType) -> Column | None:
    """Bytes of a value in a hash table, headers aside; None for a type that is not known."""
    if kind.typeName() in _FIXED_BYTES:
        return F.lit(8)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value) + 8
    if isinstance(kind, T.DecimalType):
        return F.lit(24)
    if isinstance(kind, T.ArrayType):
        if kind.elementType.typeName() in _FIXED_BYTES:
            return F.size(value) * F.lit(_FIXED_BYTES[kind.elementType.typeName()]) + 16
        if _value_bytes(F.lit(None), kind.elementType) is None:
            return None
        each = F.transform(value, lambda v: F.coalesce(_value_bytes(v, kind.elementType).cast("long"), F.lit(0).cast("long")))
        return F.aggregate(each, F.lit(16).cast("long"), lambda a, b: a + b)
    if isinstance(kind, T.StructType):
        parts = [_value_bytes(value[f.name], f.dataType) for f in kind.fields]
        if any(part is None for part in parts):
            return None
        return sum((F.coalesce(p.cast("long"), F.lit(0)) for p in parts), F.lit(16).cast("long"))
    if isinstance(kind, T.MapType):
        sides = [
            _value_bytes(side(value), T.ArrayType(t))
            for side, t in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))
        ]
        return None if any(side is None for side in sides) else sides[0] + sides[1]
    return None


def bounded_broadcast(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes; beyond the bound Spark shuffles.

    Strings, arrays, maps and structs count with all they hold; a column of a type whose size is
    not known gets no hint.  ``df`` should be a stored table, since it is read once more.
    """
    sizes = [_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    if any(size is None for size in sizes):
        return df
    width = sum((F.coalesce(size.cast("long"), F.lit(8)) for size in sizes), F.lit(0))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("bytes")).first()
    return F.broadcast(df) if found.n <= max_rows and (found.bytes or 0) <= max_bytes else df


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per context.

    Python functions that run on executors are found by module name, so the workers need
    the package whatever folder the driver was started in.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fleetlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fleetlens-")), "fleetlens.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._fleetlens_shipped = True
