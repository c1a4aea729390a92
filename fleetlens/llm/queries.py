"""One query per corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import suffix_tree_lm
from fleetlens.llm.common import in_fold, table
from fleetlens.llm.decontaminate import contamination
from fleetlens.llm.fingerprints import spliced_fingerprints
from fleetlens.llm.jaccard_join import jaccard_join
from fleetlens.llm.license_rules import scan_licenses
from fleetlens.llm.prefix_trie import prefix_trie
from fleetlens.llm.repeats import remove_repeats
from fleetlens.llm.secrets import KINDS, scan_secrets
from fleetlens.llm.secrets import train as train_secrets
from fleetlens.llm.sentence_pieces import encode
from fleetlens.llm.sharding import shard_documents
from fleetlens.llm.toxicity import score_toxicity, train_toxicity
from fleetlens.llm.url_rules import judge_urls
from fleetlens.llm.whitening import whiten

#: The url rules of the query, ``(host, path, verdict)``.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def joined(array: str) -> Column:
    return F.concat_ws(",", array)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_known"),
        joined("sentences").alias("sentences"),
        joined("licenses").alias("licenses"),
    )


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 5, 1)
    corpus = suffix_tree_lm.encode(documents, ~held_out)
    tree = suffix_tree_lm.train(corpus)
    found = suffix_tree_lm.score_texts(corpus, tree)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tree.n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text, and whether decoding them gives the text back."""
    decoded = encode(table(spark, sf_dir, "documents"), spell=True)
    return decoded.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        "pieces",
        F.sha2("text", 256).alias("decoded_sha256"),
        # The hash of a null text is that of no value; it decodes to the empty text.
        (F.coalesce(F.xxhash64("text") == F.col("text_hash"), F.lit(False)) | (F.col("text") == "")).alias("round_trip"),
    )


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda item: item.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = scan_secrets(documents, train_secrets(documents))
    order = {kind: at for at, kind in enumerate(KINDS)}

    def listed(spans: Column) -> Column:
        rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
        keyed = F.transform(
            spans, lambda s: F.struct(s["start"], F.coalesce(rank[s["kind"]], F.lit(len(order))).alias("rank"), s["end"], s["kind"].alias("kind"))
        )
        return F.concat_ws(",", F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = train_toxicity(documents, table(spark, sf_dir, "labels").where(~held_out))
    found = score_toxicity(documents, model)
    spans = F.transform("sentences", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.concat_ws(",", spans).alias("toxic_spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spliced_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    facts = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    return found.select(F.col("id").alias("vec_id"), *facts)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_license_rules": op2_license_rules,
        "op3_suffix_tree_lm": op3_suffix_tree_lm,
        "op4_url_rules": op4_url_rules,
        "op5_sentence_pieces": op5_sentence_pieces,
        "op6_repeats": op6_repeats,
        "op7_decontaminate": op7_decontaminate,
        "op8_secrets": op8_secrets,
        "op9_toxicity": op9_toxicity,
        "op10_fingerprints": op10_fingerprints,
        "op11_whitening": op11_whitening,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_shards": op13_shards,
    }
