"""Models: separable data is learnt, planted outliers rank first, runs are found again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.ml import fault_model, isolation_forest
from fleetlens.ml.fault_model import LABEL, FaultModel, NotTrainable, train_or_reuse
from fleetlens.ml.isolation_forest import IsolationForest, IsolationForestModel, average_path
from fleetlens.ml.store import ModelStore, NoModel
from fleetlens.operators.scoring import FEATURES, prediction_rows

COLUMNS = "vibration_mm_s double, temp_c double, throughput_cpm int, rpm int, current_amps double, humidity_pct double"


def training(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.15)
        rows.append((rng.gauss(3 + 4 * y, 1), rng.gauss(50 + 20 * y, 5), 100, 1500, 5.0, 40.0, rng.choice(["RUN", "STOPPED"]), y, f"M{i}"))
    return spark.createDataFrame(rows, f"{COLUMNS}, state string, {LABEL} int, machine_id string")


def test_fault_model_learns_and_scores_gaps(spark, tmp_path):
    rows = training(spark)
    model = FaultModel.fit(rows)
    found = model.metrics(rows)
    assert found["roc_auc"] > 0.95 and found["avg_precision"] > 0.8
    scored = model.score(rows)
    assert scored.columns == [*rows.columns, "prob"]
    assert scored.where("prob not between 0 and 1").count() == 0
    mean = dict(scored.groupBy(LABEL).agg(F.avg("prob")).collect())
    assert mean[1] > 0.8 > 0.2 > mean[0]
    # Unknown state and missing readings still get a probability; the state is not rewritten.
    odd = rows.limit(2).withColumns({"state": F.lit("MELTED"), "temp_c": F.lit(None).cast("double")})
    odd = odd.unionByName(odd.withColumn("state", F.lit(None).cast("string")))
    result = model.score(odd)
    assert result.where("prob is null").count() == 0
    assert {r["state"] for r in result.collect()} == {"MELTED", None}
    store = ModelStore(spark, str(tmp_path))
    saved = model.save(store, found)
    again = FaultModel.load_latest(store)
    assert again.run_id == saved.run_id
    assert again.score(rows).exceptAll(scored).count() == 0
    assert store.summaries("fault").first()["roc_auc"] == pytest.approx(found["roc_auc"])


def test_training_guard(spark, frames, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    calm = frames.silver.where("state = 'RUN'").withColumn("fault_code", F.lit(None).cast("string"))
    with pytest.raises(NotTrainable, match="no earlier model"):
        train_or_reuse(calm, frames.as_of, store)
    with pytest.raises(NotTrainable, match="no rows"):
        train_or_reuse(calm.where("false"), frames.as_of, store)
    with pytest.raises(NoModel):
        FaultModel.load_latest(store)
    trained = train_or_reuse(frames.silver, frames.as_of, store)
    assert train_or_reuse(calm, frames.as_of, store).run_id == trained.run_id


def test_prediction_rows_are_monotone(spark, frames):
    model = FaultModel.fit(fault_model.training_frame(frames.silver, frames.as_of, 20))
    scored = model.score(frames.silver.withColumn("inference_type", F.lit("batch")))
    rows = prediction_rows(scored, "r", F.current_timestamp())
    bad = rows.where(
        "prob_fault_next_1h < prob_fault_next_5m or prob_fault_next_24h < prob_fault_next_1h "
        "or prob_fault_next_7d < prob_fault_next_24h or predicted_fault_next_5m <> (prob_fault_next_5m >= 0.5)"
    )
    assert bad.count() == 0


def outlier_frame(spark, n=1500):
    rng = random.Random(6)
    rows = [(rng.gauss(3, 1), rng.gauss(50, 5), 100 + rng.randrange(10), 1500 + rng.randrange(100), rng.gauss(5, 1), rng.gauss(40, 3), False) for _ in range(n)]
    rows += [(14.0 + i, 110.0 + i, 5, 3400, 14.0, 95.0, True) for i in range(10)]
    return spark.createDataFrame(rows, f"{COLUMNS}, planted boolean").repartition(6)


def test_forest_ranks_planted_rows_first(spark):
    df = outlier_frame(spark)
    model = IsolationForest(n_trees=60).fit(df)
    scored = model.decision(df, "raw")
    lowest = scored.orderBy("raw").limit(10).collect()
    assert all(r["planted"] for r in lowest)
    share = scored.agg(F.avg((F.col("raw") < 0).cast("double"))).first()[0]
    assert share == pytest.approx(0.05, abs=0.01)


def test_forest_is_repeatable_and_saved(spark, tmp_path):
    df = outlier_frame(spark, 300)
    first, second = (IsolationForest(n_trees=10).fit(df) for _ in range(2))
    key = ["tree", "node"]
    assert first.nodes.sort_values(key).reset_index(drop=True).equals(second.nodes.sort_values(key).reset_index(drop=True))
    store = ModelStore(spark, str(tmp_path))
    saved = first.save(store)
    loaded = IsolationForestModel.load_latest(store)
    assert loaded.run_id == saved.run_id
    assert loaded.decision(df).exceptAll(first.decision(df)).count() == 0


def test_forest_sample_is_bounded(spark):
    wide = spark.range(60_000).select(*[(F.rand(i) * 10).alias(c) for i, c in enumerate(FEATURES)])
    forest = IsolationForest(n_trees=20, sample_size=64)
    drawn = forest._samples(wide)
    per_tree = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(per_tree) == 20 and max(per_tree) < 64 * 3 and min(per_tree) >= 64
    model = forest.fit(wide)
    assert model.sample == 64 and model.nodes.groupby("tree").size().max() <= 2 * 64


def test_identical_rows_do_not_break_the_forest(spark):
    same = spark.range(500).select(*[F.lit(1.0).alias(c) for c in FEATURES])
    model = IsolationForest(n_trees=5).fit(same)
    assert model.decision(same).select("raw").distinct().count() == 1
    with pytest.raises(ValueError):
        IsolationForest().fit(same.where("false"))


def test_average_path_formula():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256, rel=1e-6)


def test_anomaly_training_window(frames):
    rows = isolation_forest.training_frame(frames.silver, frames.as_of)
    assert 0 < rows.count() <= frames.silver.count()


def test_models_run_from_any_folder(tmp_path):
    """Workers find the package though neither their folder nor a path setting leads to it."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry_point
queries = entry_point.queries()
print("rows", queries["anomaly_score_model"](spark, "/root/testdata/sf0.001").count())
print("found", queries["model_registry_lookup"](spark, "/root/testdata/sf0.001").first()["newest_found"])
spark.stop()
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout and "found True" in done.stdout, done.stderr[-2000:]


def test_same_forest_on_another_partitioning(frames):
    rows = isolation_forest.training_frame(frames.silver, frames.as_of).select("machine_id", "event_time", *isolation_forest.FEATURES)
    one, two = (isolation_forest.IsolationForest(n_trees=5).fit(rows.repartition(n)) for n in (1, 5))
    order = ["tree", "node"]
    assert one.nodes.sort_values(order).reset_index(drop=True).equals(two.nodes.sort_values(order).reset_index(drop=True))
