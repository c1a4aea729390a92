"""Whitening of embeddings by a weighted covariance of the distinct vectors.

Entries ``c`` become whole numbers ``x = floor(256 c)``.  Equal x vectors are grouped, with a
count combined before the shuffle, so a vector that a third of all rows share is one row from
there on.  Sums per dimension are exact.  Every task then centres its distinct vectors and adds
up one weighted product of them (a matrix of dim x dim numbers); the sum of these over the tasks
is the covariance, whose eigenvectors the driver takes.  Every distinct vector is whitened once
and joined back to its rows.  Only sums, the covariance and the components of it pass the
driver: their size follows the dimension, not the rows.

Defined results

* A vector that is null or holds a null, NaN or infinite entry is dropped with its row.
* Vectors of different lengths are whitened apart, each length with its own ``n`` and covariance;
  an empty vector has no dimension, so no row of the result.
* A row keeps its id whatever it is (null, repeated); equal rows give equal rows.
* There are as many components as asked for, at most as many as dimensions.  A component
  without variance has a null ``whitened`` and does not count for ``identity_error``; where no
  component has variance, ``explained`` and ``identity_error`` are null.
* Entries beyond the range of a long become its ends; a ``deviation`` beyond it is null.
* Other columns of the input are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ready
from fleetlens.llm.hot import join_counted
from fleetlens.session import stored

SCALE = 256
COMPONENTS = 4
_HALF = 32
_LONG = 2**63


@dataclass(frozen=True)
class Whitener:
    """What the fit list of one vector length gives: exact sums, components and their variances."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # dim x components, unit columns
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` with one rounding, where whole numbers of a long can express it."""
        whole = self._whole(x)
        return whole / self.n if whole is not None else x - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        whole = self._whole(x)
        if whole is not None and len(self.sums) * int(np.abs(whole).max(initial=0)) ** 2 < _LONG:
            return (whole * whole).sum(axis=1).tolist()
        sums = self.sums
        found = [sum((self.n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [d if d < _LONG else None for d in found]

    def _whole(self, x: np.ndarray) -> np.ndarray | None:
        most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
        if self.n * most + max(map(abs, self.sums), default=0) >= _LONG:
            return None
        return self.n * x - np.array(self.sums, dtype=np.int64)

    def live(self) -> np.ndarray:
        """Which components have variance, beyond what rounding leaves."""
        return self.variances > self.trace * len(self.sums) * np.finfo(float).eps

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.live(), np.sqrt(np.maximum(self.variances, 0)), np.nan)
        return self.centred(x) @ self.directions / scale


def whole_vectors(rows: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, x``: the usable rows with their entries as whole numbers."""
    entries = F.col(vector)

    def usable(c: Column) -> Column:
        value = c.cast("double")
        return c.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))

    x = F.transform(entries, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return rows.where((F.size(entries) > 0) & F.forall(entries, usable)).select(F.col(id_column).alias("id"), x.alias("x"))


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dim, positions in the batch, matrix)`` for every vector length of a batch."""
    vectors = batch.column(column)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(dim), at, flat.reshape(len(at), int(dim))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of a task's vectors, upper and lower halves apart, so that none overflows."""
    total: dict[int, list] = {}
    for batch in batches:
        weights = batch.column("fit_weight").to_numpy(zero_copy_only=False)
        for dim, at, x in _matrices(batch, "x"):
            w = weights[at]
            kept = total.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
            kept[0] += int(w.sum())
            kept[1] += w @ (x >> _HALF)
            kept[2] += w @ (x & (2**_HALF - 1))
    for dim, (n, upper, lower) in total.items():
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([dim] * dim, pa.int32()),
                "pos": pa.array(range(dim), pa.int32()),
                "n": pa.array([n] * dim, pa.int64()),
                "upper": pa.array(upper),
                "lower": pa.array(lower),
            }
        )


def _products(column: str, centre: Callable) -> Callable:
    """Task function: the weighted product of a task's centred vectors, row by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column("fit_weight").to_numpy(zero_copy_only=False).astype(float)
            for dim, at, x in _matrices(batch, column):
                centred = centre(dim, x)
                total[dim] = total.get(dim, 0.0) + (centred * weights[at][:, None]).T @ centred
        for dim, matrix in total.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim] * dim, pa.int32()),
                    "i": pa.array(range(dim), pa.int32()),
                    "line": pa.array(matrix.tolist(), pa.list_(pa.float64())),
                }
            )

    return run


def _covariances(distinct: DataFrame, column: str, centre: Callable, n: dict[int, int]) -> dict[int, np.ndarray]:
    """Covariance per vector length, divisor ``n``."""
    lines = distinct.mapInArrow(_products(column, centre), "dim int, i int, line array<double>")
    cells = lines.select("dim", "i", F.posexplode("line").alias("j", "v"))
    found = cells.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for dim, part in found.groupby("dim"):
        matrix = np.zeros((dim, dim))
        matrix[part["i"], part["j"]] = part["v"]
        out[int(dim)] = (matrix + matrix.T) / 2 / n[int(dim)]
    return out


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """One :class:`Whitener` per vector length of ``distinct`` (``x, fit_weight``)."""
    halves = distinct.mapInArrow(_sums, "dim int, pos int, n long, upper long, lower long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "upper", "lower")]
    n: dict[int, int] = {}
    sums: dict[int, dict[int, int]] = {}
    for r in halves.groupBy("dim", "pos").agg(*wide).collect():
        n[r.dim] = int(r.n)
        sums.setdefault(r.dim, {})[r.pos] = (int(r.upper) << _HALF) + int(r.lower)
    exact = {dim: tuple(found[k] for k in range(dim)) for dim, found in sums.items()}
    none = np.zeros(0)
    plain = {dim: Whitener(n[dim], s, none, none, 0.0) for dim, s in exact.items()}
    fitted = {}
    for dim, v in _covariances(distinct, "x", lambda d, x: plain[d].centred(x), n).items():
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(values, kind="stable")[::-1][:components]
        fitted[dim] = Whitener(n[dim], exact[dim], vectors[:, order], values[order], float(np.trace(v)))
    return fitted


def _whitened(model: dict[int, Whitener]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _matrices(batch, "x"):
                part, place = batch.take(pa.array(at)), model[dim]
                yield pa.RecordBatch.from_pydict(
                    {
                        "x": part.column("x"),
                        "n_rows": part.column("n_rows"),
                        "fit_weight": part.column("fit_weight"),
                        "deviation": pa.array(place.deviations(x), pa.int64()),
                        "white": pa.array(place.whiten(x).tolist(), pa.list_(pa.float64())),
                        "dim": pa.array([dim] * len(at), pa.int32()),
                    }
                )

    return run


def _identity_errors(white: DataFrame, model: dict[int, Whitener]) -> dict[int, float | None]:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    live = {dim: m.live() for dim, m in model.items()}
    weighted = F.col("v") * F.col("fit_weight")
    cells = white.select("dim", "fit_weight", F.posexplode("white").alias("k", "v"))
    means = {dim: np.zeros(len(m.variances)) for dim, m in model.items()}
    for r in cells.groupBy("dim", "k").agg(F.sum(weighted).alias("total")).collect():
        means[r.dim][r.k] = r.total / model[r.dim].n
    # Lengths with the same number of components share a matrix shape, so they are told apart by dim.
    errors: dict[int, float | None] = {}
    for dim, m in model.items():
        count = len(m.variances)
        part = white.where(F.col("dim") == dim)
        found = _covariances(part, "white", lambda _, w, mean=means[dim]: w - mean, {count: m.n})[count]
        at = np.flatnonzero(live[dim])
        errors[dim] = float(np.abs(found[np.ix_(at, at)] - np.eye(len(at))).max()) if len(at) else None
    return errors


def whiten(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    weights: str = "one",
) -> DataFrame:
    """``id, dim, component, n, deviation, whitened, explained, identity_error``.

    ``weights`` says what a distinct vector counts in the fit: ``one``, or ``count`` of its rows.
    ``n`` is the weight of the fit list and ``deviation`` is exact, the sum over the dimensions
    of ``(n x - S)^2``, S being the weighted sum of the dimension.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights are one or count, not {weights}")
    spark = rows.sparkSession
    ready(spark)
    keyed = whole_vectors(rows, id_column, vector)
    counted = keyed.groupBy("x").agg(F.count(F.lit(1)).alias("n_rows"))
    weight = F.lit(1).cast("long") if weights == "one" else F.col("n_rows")
    distinct = stored(counted.withColumn("fit_weight", weight))
    model = fit(distinct, components)
    schema = "x array<long>, n_rows long, fit_weight long, deviation long, white array<double>, dim int"
    white = stored(distinct.mapInArrow(_whitened(model), schema))
    errors = _identity_errors(white, model)
    facts = [
        (dim, k, m.n, float(e / m.trace) if m.trace > 0 else None, errors[dim])
        for dim, m in model.items()
        for k, e in enumerate(m.variances)
    ]
    table = spark.createDataFrame(facts, "dim int, k int, n long, explained double, identity_error double")
    back = join_counted(keyed, white.select("x", "n_rows", "deviation", "white", "dim"), ["x"], "n_rows")
    cells = back.select("id", "dim", "deviation", F.posexplode("white").alias("k", "w"))
    return cells.join(F.broadcast(table), ["dim", "k"]).select(
        "id",
        "dim",
        (F.col("k") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
        "explained",
        "identity_error",
    )
