"""Isolation forest (Liu, Ting, Zhou 2008) trained on per-tree samples.

A tree sees a few hundred rows whatever the table holds.  The rows are drawn on the
cluster, each tree is built in its own task, and only the tree tables - bounded by
trees x sample size - reach the driver, to be broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.expr import before, rows_since
from fleetlens.ml.store import ModelStore
from fleetlens.operators.percentiles import exact_value_at
from fleetlens.operators.scoring import FEATURES, drop_incomplete
from fleetlens.plans.semantic import AsOf
from fleetlens.session import pin, ship, stored

KIND = "anomaly"
TRAINING_DAYS = 2
NODES = "tree int, node int, depth int, feature int, threshold double, length double"
_SPARE = 1.5  # draw this many times the rows needed, then keep exactly the sample size
_BUCKETS = 1 << 20
_BLOCK = 1024  # rows scored at a time, so that the work arrays stay in the CPU cache


def average_path(n: float) -> float:
    """Average path length of an unsuccessful search in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, tree: int, rng: np.random.Generator) -> list[tuple]:
    """Split at random until rows are alone or the depth limit is reached.

    Nodes are numbered like a heap (children of i are 2i + 1 and 2i + 2); a leaf has
    feature -1 and carries its path length.
    """
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    nodes = []
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, rows = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(varying) == 0:
            nodes.append((tree, node, depth, -1, 0.0, depth + average_path(len(rows))))
            continue
        feature = int(rng.choice(varying))
        # Below the highest value, so that neither side is empty.
        threshold = min(float(rng.uniform(low[feature], high[feature])), np.nextafter(high[feature], low[feature]))
        goes_left = x[rows, feature] <= threshold
        nodes.append((tree, node, depth, feature, threshold, 0.0))
        todo.append((2 * node + 1, depth + 1, rows[goes_left]))
        todo.append((2 * node + 2, depth + 1, rows[~goes_left]))
    return nodes


def mean_path(
    x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, length: np.ndarray
) -> np.ndarray:
    """Mean path length of each row over all trees; all trees step down together."""
    trees, inner = feature.shape
    rows, width = x.shape
    tree_start = np.arange(trees, dtype=np.int64) * inner
    row_start = np.arange(rows, dtype=np.int64)[:, None] * width
    at = np.zeros((rows, trees), dtype=np.int64)
    for _ in range((inner + 1).bit_length() - 1):
        spot = tree_start + at
        reading = x.ravel().take(row_start + feature.ravel().take(spot))
        at = 2 * at + 1 + (reading > threshold.ravel().take(spot))
    leaf = np.arange(trees, dtype=np.int64) * (inner + 1) + (at - inner)
    return length.ravel().take(leaf).mean(axis=1)


@dataclass(frozen=True)
class IsolationForest:
    n_trees: int = 150
    contamination: float = 0.05
    seed: int = 42
    sample_size: int = 256
    features: Sequence[str] = FEATURES

    def _base(self, rows: DataFrame) -> DataFrame:
        """(id, features) of all rows, stored: counted, drawn from and scored.

        Spread evenly, since a file of few row groups is read by few tasks.
        """
        # The row itself decides, so another partitioning draws the same rows.
        values = [F.col(c).cast("double").alias(c) for c in self.features]
        return stored(rows.select(F.xxhash64(*rows.columns).alias("_id"), *values).hint("rebalance"))

    def _samples(self, rows: DataFrame) -> DataFrame:
        return self._draw(self._base(rows))

    def _draw(self, pool: DataFrame) -> DataFrame:
        """(tree, order, features): about 1.5 sample sizes of random rows per tree."""
        total = pool.count()
        if total == 0:
            raise ValueError("no complete rows to train on")
        wanted = self.n_trees * self.sample_size * _SPARE
        chance = F.pmod(F.xxhash64("_id", F.lit(self.seed), F.lit("pool")), F.lit(_BUCKETS))
        pool = pin(pool.where(chance < min(1.0, wanted / total) * _BUCKETS))
        share = min(1.0, self.sample_size * _SPARE / max(1, pool.count()))

        def ticket(tree):
            return F.pmod(F.xxhash64(F.col("_id"), tree, F.lit(self.seed)), F.lit(_BUCKETS))

        every_tree = F.sequence(F.lit(0), F.lit(self.n_trees - 1))
        joined = F.filter(every_tree, lambda t: ticket(t) < share * _BUCKETS)
        drawn = pool.withColumn("tree", F.explode(joined))
        return drawn.withColumn("_order", ticket(F.col("tree"))).drop("_id")

    def fit(self, df: DataFrame) -> "IsolationForestModel":
        """Grow the trees and set the cut so that ``contamination`` of the rows lie below it."""
        ship(df.sparkSession)
        rows = self._base(drop_incomplete(df, self.features))
        names, size, seed = list(self.features), self.sample_size, self.seed

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            kept = pdf.sort_values(["_order", *names], kind="stable").head(size)
            grown = grow(kept[names].to_numpy(), tree, np.random.default_rng([seed, tree]))
            return pd.DataFrame(grown, columns=[f.split()[0] for f in NODES.split(", ")])

        drawn = pin(self._draw(rows))
        nodes = drawn.groupBy("tree").applyInPandas(build, NODES).toPandas()
        per_tree = drawn.groupBy("tree").agg(F.count("*").alias("n")).agg(F.avg(F.least("n", F.lit(size))))
        model = IsolationForestModel(nodes, float(per_tree.first()[0]), 0.0, tuple(names))
        # Scored once and stored: the cut reads the scores a few times.
        scores = stored(model.decision(rows, "_d").select("_d"))
        cut = exact_value_at(scores, "_d", lambda n: int(n * self.contamination))
        return IsolationForestModel(nodes, model.sample, cut, tuple(names))


@dataclass(frozen=True)
class IsolationForestModel:
    """Tree tables, mean rows per tree, and the score below which a row is unusual."""

    nodes: pd.DataFrame
    sample: float
    offset: float
    features: tuple[str, ...]
    run_id: str = "unsaved"

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Perfect trees of equal depth: split features, split values, path length per leaf.

        A leaf above the bottom hands every row down its left edge.
        """
        deepest = int(self.nodes["depth"].max())
        trees = self.nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1
        shape = (trees.max() + 1, 2**deepest - 1)
        feature, threshold = np.zeros(shape, dtype=np.int32), np.full(shape, np.inf)
        length = np.zeros((shape[0], 2**deepest))
        split = self.nodes["feature"].to_numpy() >= 0
        node = self.nodes["node"].to_numpy()
        feature[trees[split], node[split]] = self.nodes["feature"].to_numpy()[split]
        threshold[trees[split], node[split]] = self.nodes["threshold"].to_numpy()[split]
        # Left-most descendant of node i, k levels down, is (i + 1) * 2^k - 1.
        below = deepest - self.nodes["depth"].to_numpy()[~split]
        bottom = (node[~split] + 1) * 2**below - 2**deepest
        length[trees[~split], bottom] = self.nodes["length"].to_numpy()[~split]
        return feature, threshold, length

    def decision(self, df: DataFrame, name: str = "raw") -> DataFrame:
        """Add the decision value: negative for unusual rows.  Features must not be NULL."""
        ship(df.sparkSession)
        tables = df.sparkSession.sparkContext.broadcast(self._tables())
        scale, offset = average_path(self.sample) or 1.0, self.offset

        @F.pandas_udf(T.DoubleType())
        def value(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            path = np.concatenate(
                [mean_path(x[i : i + _BLOCK], *tables.value) for i in range(0, len(x), _BLOCK)] or [x[:, 0]]
            )
            return pd.Series(-np.exp2(-path / scale) - offset)

        return df.withColumn(name, value(*[F.col(c).cast("double") for c in self.features]))

    def save(self, store: ModelStore) -> "IsolationForestModel":
        run_id, folder = store.new_run(KIND)
        frame = store.spark.createDataFrame(self.nodes, NODES)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes")
        summary = {"sample": self.sample, "offset": self.offset, "features": ",".join(self.features)}
        store.finish(folder, run_id, summary)
        return IsolationForestModel(self.nodes, self.sample, self.offset, self.features, run_id)

    @staticmethod
    def load_latest(store: ModelStore) -> "IsolationForestModel":
        run_id, folder = store.latest(KIND)
        nodes = store.spark.read.parquet(f"{folder}/nodes").toPandas()
        told = store.spark.read.json(f"{folder}/summary").first()
        names = tuple(told["features"].split(","))
        return IsolationForestModel(nodes, told["sample"], told["offset"], names, run_id)


def training_frame(silver: DataFrame, as_of: AsOf) -> DataFrame:
    """Complete rows of the training window."""
    window = rows_since(silver, "event_time", before(as_of, days=TRAINING_DAYS))
    return drop_incomplete(window, ["machine_id", "event_time", *FEATURES, "state"])

