"""Exact areas under the curves of a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import stored


def areas(scored: DataFrame, score: str, positive: Column) -> tuple[float, float]:
    """Areas under ROC and under precision by recall; every distinct score is a point of both.

    As in MLlib's ``BinaryClassificationMetrics`` without bins, the curves are joined by straight
    lines and precision starts at that of the highest score.  Without negative rows the first area
    is 1, without positive ones both are 0; without rows it is an error.

    Both come from one table of the distinct scores: rows of a score are counted first, the scores
    cut into ranges, and running sums go over the ranges, then inside each range.
    """
    hit = F.coalesce(positive, F.lit(False))
    counted = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(hit).alias("p"), F.count_if(~hit).alias("n"))
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of a range follows its place; stored, so that it is the same for both uses.
    points = stored(counted.repartitionByRange(ranges, F.desc("score")).withColumn("range", F.spark_partition_id()))
    sums = points.groupBy("range").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).orderBy("range").collect()
    if not sums:
        raise ValueError("no scores to measure")
    starts, all_p, all_n = [], 0, 0
    for part in sums:
        starts.append((part["range"], all_p, all_n))
        all_p, all_n = all_p + part["p"], all_n + part["n"]
    if not all_p or not all_n:
        return (1.0, 1.0) if all_p else (0.0, 0.0)
    before = scored.sparkSession.createDataFrame(starts, "range int, before_p long, before_n long")
    down = Window.partitionBy("range").orderBy(F.desc("score"))
    curve = points.join(F.broadcast(before), "range").select(
        "p",
        "n",
        (F.col("before_p") + F.sum("p").over(down)).alias("tp"),
        (F.col("before_n") + F.sum("n").over(down)).alias("fp"),
    )
    # Rows above this score; none above the highest.
    above_p, above = F.col("tp") - F.col("p"), F.col("tp") + F.col("fp") - F.col("p") - F.col("n")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    last_precision = F.when(above > 0, above_p / above).otherwise(precision)
    found = curve.agg(
        F.sum(F.col("n") * (above_p + F.col("tp")) / 2).alias("roc"),
        F.sum(F.col("p") * (last_precision + precision) / 2).alias("pr"),
    ).first()
    return found.roc / (float(all_p) * all_n), found.pr / all_p
