"""Row quality rules that warn: rows are kept, violations are counted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import count_if
from fleetlens.schemas import STATES


@dataclass(frozen=True)
class Rule:
    """``column`` must lie in [low, high] or be one of ``allowed``; NULL violates."""

    name: str
    column: str
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()

    def violated(self) -> Column:
        value = F.col(self.column)
        holds = value.isin(*self.allowed) if self.allowed else F.lit(True)
        if self.low is not None:
            holds = holds & (value >= self.low)
        if self.high is not None:
            holds = holds & (value <= self.high)
        return ~F.coalesce(holds, F.lit(False))


# Rule names and limits.
RULES = (
    Rule("valid_state", "state", allowed=STATES),
    Rule("non_negative_throughput", "throughput_cpm", low=0),
    Rule("temp_reasonable", "temp_c", -20, 250),
    Rule("vibration_reasonable", "vibration_mm_s", 0, 100),
    Rule("rpm_reasonable", "rpm", 0, 10000),
    Rule("current_reasonable", "current_amps", 0, 50),
    Rule("humidity_reasonable", "humidity_pct", 0, 100),
    Rule("load_reasonable", "load_pct", 0, 100),
    Rule("power_reasonable", "power_kw", 0, 200),
    Rule("power_factor_reasonable", "power_factor", 0, 1),
    Rule("voltage_reasonable", "voltage_v", 100, 600),
    Rule("pressure_reasonable", "pressure_bar", 0, 50),
    Rule("flow_reasonable", "flow_rate_lpm", 0, 1000),
)


def _counters(rules: Sequence[Rule]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows_checked")] + [
        count_if(rule.violated()).alias(rule.name) for rule in rules
    ]


def count_violations(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule with its violations, from a single aggregate over ``df``."""
    wide = df.agg(*_counters(rules))
    per_rule = [
        F.struct(F.lit(rule.name).alias("rule"), F.col(rule.name).alias("violations"))
        for rule in rules
    ]
    return wide.select("rows_checked", F.inline(F.array(*per_rule))).select(
        "rule", "violations", "rows_checked"
    )


def flag_rows(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``violated_rules``, the names of the rules each row breaks."""
    named = F.array(*[F.when(rule.violated(), F.lit(rule.name)) for rule in rules])
    return df.withColumn("violated_rules", F.array_compact(named))


def observe_rules(df: DataFrame, name: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Count violations while ``df`` is processed; read them from the query progress."""
    return df.observe(name, *_counters(rules))
