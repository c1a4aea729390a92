"""Serial text lines of a device panel, and metrics derived from their few fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import at_least, clamp
from fleetlens.schemas import STATES
from fleetlens.sources.bronze import clear_fault

SERIAL_FIELDS = ("vibration_mm_s", "temp_c", "throughput_cpm", "state", "fault_code")


def parse_serial_csv(
    lines: DataFrame, line: str = "line", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """``vibration,temp,throughput,state,fault[,more]`` to (good rows, rejected lines).

    Rejected lines keep their text and get a ``reject_reason``.
    """
    part = F.split(F.col(line), ",", -1)
    field = [F.trim(F.get(part, F.lit(i))) for i in range(len(SERIAL_FIELDS))]
    typed = lines.select(
        F.col(line),
        *keep,
        F.size(part).alias("_fields"),
        field[0].try_cast("double").alias("vibration_mm_s"),
        field[1].try_cast("double").alias("temp_c"),
        field[2].try_cast("int").alias("throughput_cpm"),
        field[3].alias("state"),
        clear_fault(field[4]).alias("fault_code"),
    )
    unreadable = F.greatest(
        *[F.col(name).isNull() for name in ("vibration_mm_s", "temp_c", "throughput_cpm")]
    )
    reason = (
        F.when(F.col(line).isNull() | (F.col("_fields") < len(SERIAL_FIELDS)), "field count")
        .when(~F.col("state").isin(*STATES), "state")
        .when(unreadable, "number")
        .when(F.col("throughput_cpm") < 0, "negative throughput")
    )
    judged = typed.withColumn("reject_reason", reason)
    good = judged.where("reject_reason is null").select(*keep, *SERIAL_FIELDS)
    rejects = judged.where("reject_reason is not null").select(*keep, line, "reject_reason")
    return good, rejects


def derive_metrics(df: DataFrame) -> DataFrame:
    """Add the electrical and process metrics implied by throughput and temperature.

    ``rpm``, ``current_amps``, ``humidity_pct``, ``voltage_v`` and ``power_factor``
    are estimated only when the input has no such column.
    """
    pace = F.col("throughput_cpm")
    estimates = {
        "rpm": clamp(pace * 25, 0, 3000).cast("int"),
        "current_amps": F.round(clamp(F.lit(2.0) + pace / F.lit(120.0) * F.lit(11.0), 0.5, 15), 3),
        "humidity_pct": F.round(
            clamp(F.lit(30.0) + (F.col("temp_c") - F.lit(30.0)) * F.lit(0.7), 30, 85), 1
        ),
        "voltage_v": F.lit(230.0),
        "power_factor": F.lit(0.92),
    }
    absent = {name: value for name, value in estimates.items() if name not in df.columns}
    watts = F.col("voltage_v") * F.col("current_amps") * F.col("power_factor") * F.sqrt(F.lit(3.0))
    return (
        df.withColumns(absent)
        .withColumn("load_pct", F.round(clamp(pace / F.lit(120.0) * F.lit(100.0), 0, 100), 2))
        .withColumns(
            {
                "power_kw": F.round(watts / F.lit(1000.0), 3),
                "pressure_bar": F.round(at_least(F.lit(2.5) + F.col("load_pct") / F.lit(45.0), 1), 3),
                "flow_rate_lpm": F.round(at_least(F.lit(40.0) + pace * F.lit(0.95), 5), 2),
            }
        )
    )
