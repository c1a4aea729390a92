"""Documents to model input: the corpus operators one after the other.

Each stage reads what the stage before wrote and returns a DataFrame that is written as
Parquet.  All but the last return the columns of ``documents``, in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import in_fold, ready, table
from fleetlens.llm.decontaminate import contamination
from fleetlens.llm.jaccard_join import jaccard_join
from fleetlens.llm.secrets import mask_secrets
from fleetlens.llm.secrets import train as train_secrets
from fleetlens.llm.sentence_pieces import encode
from fleetlens.llm.toxicity import keep_clean, train_toxicity
from fleetlens.session import bounded_broadcast, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _same(other: DataFrame) -> Column:
    """The row's id and text are those of ``other`` (``other_id, other_text``)."""
    return F.col("doc_id").cast("long").eqNullSafe(other["other_id"]) & (F.xxhash64("text") == other["other_text"])


def _named(rows: DataFrame) -> DataFrame:
    """Distinct ids and text hashes of ``rows``, stored and broadcast if few."""
    named = rows.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_text")).distinct()
    return bounded_broadcast(stored(named))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the training fold of the labels."""
    labels = table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), 3, 1))
    return keep_clean(docs, train_toxicity(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of equal rows, one.

    Documents without an id or without words are in no group and stay.
    """
    ready(spark)
    found = stored(jaccard_join(docs))
    rejected = _named(found.where("class_id <> doc_id"))
    kept = docs.join(rejected, _same(rejected), "left_anti")
    repeated = found.where("class_id = doc_id").groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    twice = _named(repeated)
    once = kept.join(twice, _same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, _same(twice), "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, by the contamination rule."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    rejected = _named(found.where("contaminated"))
    return docs.join(rejected, _same(rejected), "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; ``n_chars``, if there is one, follows a changed text."""
    ready(spark)
    before = "text_before"
    while before in docs.columns:
        before += "_"
    masked = mask_secrets(docs.withColumn(before, F.col("text")), train_secrets(docs))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(before))
        n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
        masked = masked.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, pieces, text``: the encoded documents and the texts their pieces decode to."""
    ready(spark)
    decoded = encode(docs, spell=True)
    return decoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", hide_secrets),
    ("sentence_pieces", to_pieces),
]

#: The learned stages are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
