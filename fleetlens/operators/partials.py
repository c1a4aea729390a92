"""Measures of a metric view from stored partial aggregates instead of events.

A partial row holds, for some dimensions and five minutes of time, what measures are made of:
row counts, sums, counts, extremes, and a quantile sketch as binary.  Partial rows merge in any
order and number, so a measure at any grain reads partials only; late events are added as
further partial rows (corrections), and none is ever rewritten.

Sums, counts, extremes and averages are those of the events.  Percentiles come from KLL sketches:
the value returned for ``q`` has a rank within ``rank_error(k)`` of ``q`` (with about 99 %
probability; 1.33 % of the rows for the default ``k``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.metrics import COUNT, MetricView, Of, Percentile, Ratio

WIDTH = "5 minutes"
#: Size of a sketch; larger is more exact.  200 is also the default of the sketch library.
SKETCH_K = 200
ROWS = "n_rows"


def rank_error(k: int = SKETCH_K) -> float:
    """Normalised rank error of a KLL sketch, from its published fit (single quantile, 99 %)."""
    return 2.296 / k**0.9021


def _slug(expression: str) -> str:
    return re.sub(r"\W+", "_", expression).strip("_")


@dataclass(frozen=True)
class Partials:
    """Partial aggregates of ``view`` by some of its dimensions and ``width`` of ``time``.

    ``by`` are source columns.  A dimension of the view can be asked for when it is made of those
    columns and of ``time`` at a grain of ``width`` or more; the time of a partial row is the start
    of its bucket, under the source's name.
    """

    view: MetricView
    by: tuple[str, ...]
    time: str
    width: str = WIDTH
    k: int = SKETCH_K

    def _needed(self) -> dict[str, Column]:
        """Column name -> aggregate over events, for all measures of the view."""
        made = {ROWS: F.count(F.lit(1))}
        for measure in self.view.measures.values():
            if isinstance(measure, Percentile):
                made[f"{_slug(measure.column)}__sketch"] = F.kll_sketch_agg_bigint(F.expr(measure.column).cast("bigint"), F.lit(self.k))
                continue
            parts = [measure] if isinstance(measure, Of) else [*measure.parts] if isinstance(measure, Ratio) else []
            if not parts and measure != COUNT:
                raise ValueError(f"{measure} cannot be merged from parts")
            for part in parts:
                made |= self._parts(part)
        return made

    @staticmethod
    def _parts(part: Of) -> dict[str, Column]:
        value, name = F.expr(part.column), _slug(part.column)
        if part.how in ("avg", "sum"):
            return {f"{name}__sum": F.sum(value), f"{name}__n": F.count(value)}
        if part.how == "count_if":
            return {f"{name}__hits": F.count_if(value)}
        return {f"{name}__{part.how}": F.expr(f"{part.how}({part.column})")}

    def build(self, events: DataFrame) -> DataFrame:
        """Partial rows of ``events``, a table or a stream with a watermark on ``time``."""
        bucket = F.window(self.time, self.width)
        made = [c.alias(name) for name, c in self._needed().items()]
        found = events.groupBy(*self.by, bucket.alias("_bucket")).agg(*made)
        return found.select(*self.by, F.col("_bucket.start").alias(self.time), *self._needed())

    def merged(self, partials: DataFrame) -> DataFrame:
        """One row per key out of partial rows, for a smaller table with the same answers."""
        names = [c for c in partials.columns if c not in (*self.by, self.time)]
        made = [self._merge(name).alias(name) for name in names]
        return partials.groupBy(*self.by, self.time).agg(*made).select(*partials.columns)

    def _merge(self, name: str) -> Column:
        if name.endswith("__sketch"):
            return F.kll_merge_agg_bigint(name, F.lit(self.k))
        if name.endswith("__min"):
            return F.min(name)
        return F.max(name) if name.endswith("__max") else F.sum(name)

    def _measure(self, measure) -> Column:
        if measure == COUNT:
            return F.coalesce(F.sum(ROWS), F.lit(0))
        if isinstance(measure, Ratio):
            upper, lower = (self._measure(part) for part in measure.parts)
            return upper / F.nullif(lower, F.lit(0)) * F.lit(measure.scale)
        if isinstance(measure, Percentile):
            sketch = F.kll_merge_agg_bigint(f"{_slug(measure.column)}__sketch", F.lit(self.k))
            return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(measure.q)).cast("double"))
        name = _slug(measure.column)
        if measure.how == "avg":
            return F.sum(f"{name}__sum") / F.nullif(F.sum(f"{name}__n"), F.lit(0))
        if measure.how == "count_if":
            return F.coalesce(F.sum(f"{name}__hits"), F.lit(0))
        return self._merge(f"{name}__{measure.how}")

    def query(
        self,
        partials: DataFrame,
        measures: Sequence[str] | None = None,
        by: Sequence[str] = (),
        where: Column | str | None = None,
    ) -> DataFrame:
        """Measures per combination of the ``by`` dimensions, like ``MetricView.query``.

        ``where`` sees the columns of the partial rows; a limit in time holds for whole buckets.
        """
        names = list(self.view.measures) if measures is None else list(measures)
        unknown = [n for n in [*names, *by] if n not in self.view.measures and n not in self.view.dimensions]
        unknown += [d for d in by if self.view.dimensions.get(d) == self.time]
        if unknown:
            raise KeyError(f"the partials of {self.view.name} have no {unknown}")
        rows = partials if where is None else partials.where(where)
        dims = [F.expr(self.view.dimensions[d]).alias(d) for d in by]
        return rows.groupBy(*dims).agg(*[self._measure(self.view.measures[n]).alias(n) for n in names])
