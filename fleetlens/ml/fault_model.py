"""Probability of a fault within the next minutes: a weighted logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.expr import before, rows_since
from fleetlens.functions.scores import HORIZONS
from fleetlens.ml.curves import areas
from fleetlens.ml.store import ModelStore, NoModel
from fleetlens.operators.labels import label_future_fault
from fleetlens.operators.scoring import FEATURES, drop_incomplete
from fleetlens.plans.semantic import AsOf
from fleetlens.session import stored

KIND = "fault"
LABEL = "label_fault_next_5m"
TRAINING_DAYS = 7
HORIZON_S = HORIZONS["5m"]
_NUMBERS = [f"_{c}" for c in FEATURES]


class NotTrainable(ValueError):
    """The training window holds no rows, or rows of one class only."""


def training_frame(silver: DataFrame, as_of: AsOf, horizon_s: int = HORIZON_S) -> DataFrame:
    """Labelled, complete rows of the training window.

    Labels are set before incomplete rows go, so a fault without readings still counts.
    """
    window = rows_since(silver, "event_time", before(as_of, days=TRAINING_DAYS))
    labelled = label_future_fault(drop_incomplete(window), horizon_s, LABEL)
    return drop_incomplete(labelled, [*FEATURES, "state"])


def training_rows(silver: DataFrame, as_of: AsOf, horizon_s: int = HORIZON_S) -> DataFrame:
    """What the model reads of :func:`training_frame`, stored.

    Training and its figures read the rows about ten times; the events behind them are read once
    for the rows and once for the labels.  Spread evenly, since a file of few row groups is read
    by few tasks.
    """
    rows = training_frame(silver, as_of, horizon_s).select(*FEATURES, "state", LABEL)
    return stored(rows.hint("rebalance"))


def _prepared(df: DataFrame) -> DataFrame:
    """Feature columns as doubles under private names; NULLs are left to the pipeline."""
    return df.withColumns({n: F.col(c).cast("double") for n, c in zip(_NUMBERS, FEATURES)})


@dataclass
class FaultModel:
    """A trained pipeline and the horizon its labels looked ahead."""

    pipeline: PipelineModel
    run_id: str = "unsaved"
    horizon_s: int = HORIZON_S

    @staticmethod
    def fit(labelled: DataFrame, horizon_s: int = HORIZON_S) -> "FaultModel":
        """Train on rows with features, ``state`` and the 0/1 label ``horizon_s`` ahead."""
        counts = {r[LABEL]: r["n"] for r in labelled.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        if total == 0:
            raise NotTrainable("no rows to train on")
        if len(counts) < 2:
            raise NotTrainable("only one class in the training rows")
        # Balanced classes: every class weighs as much as the other.
        weight = F.when(F.col(LABEL) == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
        rows = _prepared(labelled).withColumns(
            {"_weight": weight, "_label": F.col(LABEL).cast("double")}
        )
        # Every stage reads the rows; a lost cached block is worked out again.
        rows = rows.select(*_NUMBERS, "state", "_weight", "_label").persist()
        stages = [
            Imputer(strategy="median", inputCols=_NUMBERS, outputCols=[f"{n}_i" for n in _NUMBERS]),
            VectorAssembler(inputCols=[f"{n}_i" for n in _NUMBERS], outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
            StringIndexer(inputCol="state", outputCol="_state", handleInvalid="keep"),
            OneHotEncoder(
                inputCols=["_state"], outputCols=["_state_v"], handleInvalid="keep", dropLast=True
            ),
            VectorAssembler(inputCols=["_scaled", "_state_v"], outputCol="_features"),
            # The weights sum to the row count, so 1 / total is a unit L2 penalty on the sum.
            LogisticRegression(
                featuresCol="_features",
                labelCol="_label",
                weightCol="_weight",
                maxIter=1000,
                regParam=1.0 / total,
                standardization=False,
                probabilityCol="_probability",
                rawPredictionCol="_raw",
                predictionCol="_prediction",
            ),
        ]
        try:
            return FaultModel(Pipeline(stages=stages).fit(rows), horizon_s=horizon_s)
        finally:
            rows.unpersist()

    def _transform(self, df: DataFrame) -> DataFrame:
        usual_state = self.pipeline.stages[3].labels[0]
        known = _prepared(df).withColumns(
            {"_given": F.col("state"), "state": F.coalesce("state", F.lit(usual_state))}
        )
        return self.pipeline.transform(known)

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """Add the fault probability; missing readings take the training median."""
        scored = self._transform(df).withColumn("state", F.col("_given"))
        return scored.select(*df.columns, vector_to_array("_probability")[1].alias(name))

    def metrics(self, labelled: DataFrame) -> dict[str, float]:
        """Areas under both curves, every distinct score a point."""
        scored = self._transform(labelled).select(vector_to_array("_raw")[1].alias("raw"), LABEL)
        roc, precision_recall = areas(scored, "raw", F.col(LABEL) == 1)
        return {"roc_auc": roc, "avg_precision": precision_recall}

    def save(self, store: ModelStore, summary: dict | None = None) -> "FaultModel":
        run_id, folder = store.new_run(KIND)
        self.pipeline.write().overwrite().save(f"{folder}/model")
        store.finish(folder, run_id, {"features": ",".join(FEATURES), "horizon_s": self.horizon_s, **(summary or {})})
        self.run_id = run_id
        return self

    @staticmethod
    def load_latest(store: ModelStore) -> "FaultModel":
        run_id, folder = store.latest(KIND)
        told = store.spark.read.json(f"{folder}/summary").first().asDict()
        return FaultModel(PipelineModel.load(f"{folder}/model"), run_id, int(told.get("horizon_s") or HORIZON_S))


def train_or_reuse(silver: DataFrame, as_of: AsOf, store: ModelStore) -> FaultModel:
    """Train on the last days and save the run.

    When the window has one class only, the last saved model is used; without one, or
    without any rows, it is an error.
    """
    rows = training_rows(silver, as_of)
    try:
        model = FaultModel.fit(rows)
    except NotTrainable as reason:
        try:
            return FaultModel.load_latest(store)
        except NoModel:
            raise NotTrainable(f"{reason}, and no earlier model to fall back on") from None
    return model.save(store, model.metrics(rows))


def describe(model: FaultModel, spark: SparkSession) -> DataFrame:
    """Coefficients of the trained regression by feature."""
    indexer, regression = model.pipeline.stages[3], model.pipeline.stages[-1]
    names = [*FEATURES, *[f"state={s}" for s in indexer.labels]]
    weights = regression.coefficients.toArray()
    pairs = [(n, float(w)) for n, w in zip(names, weights)]
    return spark.createDataFrame(pairs, "feature string, coefficient double")
