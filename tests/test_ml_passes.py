"""How often training reads its events, and the exact areas."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from fleetlens.ml.curves import areas
from fleetlens.ml.fault_model import train_or_reuse
from fleetlens.ml.isolation_forest import IsolationForest, training_frame
from fleetlens.ml.store import ModelStore


def counted(df):
    """``df`` and an accumulator of the rows read from it."""
    read = df.sparkSession.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    return df.mapInPandas(count, df.schema), read


def test_fault_training_reads_events_for_rows_and_labels_only(spark, frames, tmp_path):
    silver, read = counted(frames.silver)
    train_or_reuse(silver, frames.as_of, ModelStore(spark, str(tmp_path)))
    assert 0 < read.value <= 2 * frames.silver.count()


def test_forest_reads_its_rows_once(frames):
    rows, read = counted(training_frame(frames.silver, frames.as_of))
    IsolationForest(n_trees=3).fit(rows)
    assert read.value == training_frame(frames.silver, frames.as_of).count()


@pytest.mark.parametrize("values", [1, 2, 9, 100_000])
def test_areas_are_those_of_all_points(spark, values):
    rng = random.Random(values)
    rows = [(float(rng.randrange(values)) / 7, int(rng.random() < 0.3)) for _ in range(700)]
    rows = [(score + label, label) for score, label in rows] if values > 2 else rows
    df = spark.createDataFrame(rows, "score double, label int").repartition(3)
    found = areas(df, "score", F.col("label") == 1)
    doubles = df.withColumn("label", F.col("label").cast("double"))
    for got, metric in zip(found, ("areaUnderROC", "areaUnderPR")):
        evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", metricName=metric, numBins=0)
        assert got == pytest.approx(evaluator.evaluate(doubles), rel=1e-12)


def test_areas_of_one_class(spark):
    df = spark.createDataFrame([(0.5, 1), (0.25, 1)], "score double, label int")
    assert areas(df, "score", F.col("label") == 1) == (1.0, 1.0)
    assert areas(df, "score", F.col("label") == 0) == (0.0, 0.0)
    with pytest.raises(ValueError):
        areas(df.where("false"), "score", F.col("label") == 1)
