"""Benchmark decontamination: a hash set of test n-grams scanned over every document.

Only DataFrame functions.  The benchmark's windows are counted before their hashes become
a set inside the scan; beyond ``max_windows`` the same hashes go through a join instead.
A hash hit is verified on the words themselves, so equal hashes alone never decide.

Defined results: null or wordless documents have no words, no hits and are never
contaminated; null or wordless items are ignored; items with equal texts all count;
repeated rows are judged row by row; other columns of the inputs are not looked at.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, clean_text
from fleetlens.session import bounded_broadcast, stored

WINDOW = 13
#: Whatever is not a digit, a letter a-z or beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_WINDOWS = 200_000
_PLACES = "array<struct<pos:int,n:int>>"


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased A-Z; null has none."""
    return F.filter(F.split(ascii_lower(clean_text(text)), SEPARATORS), lambda word: word != "")


def _starts(n) -> Column:
    """Start positions of the windows of ``n`` words of column ``w``."""
    count = F.size("w") - n + 1
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, n, words)``: each distinct window of each item; a short item is one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    windows = F.transform(_starts(n), lambda i: F.slice("w", i, n))
    return items.select("item_id", n.alias("n"), F.explode(windows).alias("words")).distinct()


def _hits(n: int, keys: list) -> Column:
    """Windows of ``n`` words of column ``w`` whose first word and hash are in the set."""
    hashes = sorted({key.h for key in keys if key.n == n})
    heads = sorted({key.head for key in keys if key.n == n})

    def hit(i: Column) -> Column:
        return F.element_at("w", i).isin(heads) & F.xxhash64(F.slice("w", i, n)).isin(hashes)

    return F.transform(F.filter(_starts(n), hit), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n")))


def _hashes(n: int) -> Column:
    """All windows of ``n`` words of column ``w``, with their hashes."""
    window = lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(F.slice("w", i, n)).alias("h"))
    return F.transform(_starts(n), window)


def _scan(docs: DataFrame, keys: list) -> DataFrame:
    """Add ``at``: the windows found in the set."""
    found = [_hits(n, keys) for n in sorted({key.n for key in keys})]
    return docs.withColumn("at", F.concat(*found) if found else F.array().cast(_PLACES))


def _lookup(docs: DataFrame, keys: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark too large for a set: hashes of all windows join its hashes."""
    found = [docs.select("row_key", F.explode(_hashes(n)).alias("x")).select("row_key", "x.*") for n in lengths]
    each = functools.reduce(DataFrame.unionByName, found)
    places = each.join(keys.select("n", "h").distinct(), ["n", "h"]).groupBy("row_key")
    places = places.agg(F.collect_set(F.struct("pos", "n")).alias("at"))
    return docs.join(places, "row_key", "left").withColumn("at", F.coalesce("at", F.array().cast(_PLACES)))


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """One row per document row.

    ``doc_id, text_hash, n_words, n_hit, items`` (ids with an occurring window), ``places``
    (first word, words of each occurring window) and ``contaminated``.
    """
    windows = stored(benchmark_windows(benchmark, window))
    keys = windows.select("n", F.xxhash64("words").alias("h"), F.element_at("words", 1).alias("head")).distinct()
    lengths = [row.n for row in keys.select("n").distinct().orderBy("n").collect()]
    # The key ties a row to its hits within this one plan.
    docs = documents.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.monotonically_increasing_id().alias("row_key"),
        words_of(F.col("text")).alias("w"),
    )
    docs = _scan(docs, keys.collect()) if keys.count() <= max_windows else _lookup(docs, keys, lengths)
    # From here on words travel only with a hit: a few rows of a contaminated document.
    with_words = F.transform("at", lambda x: F.struct(x.pos, x.n, F.slice("w", x.pos, x.n).alias("words")))
    hits = docs.select("doc_id", "text_hash", "row_key", F.size("w").cast("long").alias("n_words"), with_words.alias("at"))
    hits = hits.select("doc_id", "text_hash", "row_key", "n_words", F.explode_outer("at").alias("x"))
    hits = hits.select("doc_id", "text_hash", "row_key", "n_words", "x.pos", "x.n", F.col("x.words").alias("words"))
    named = stored(windows.groupBy("words").agg(F.collect_set("item_id").alias("ids")))
    hits = hits.join(bounded_broadcast(named, max_windows), "words", "left")
    judged = hits.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("ids").isNotNull(), F.struct("pos", "n")))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(1).alias("next"), F.lit(0).alias("hit")),
        lambda state, x: F.struct(
            F.greatest(state.next, x.pos + x.n).alias("next"),
            (state.hit + F.greatest(F.lit(0), x.pos + x.n - F.greatest(state.next, x.pos))).alias("hit"),
        ),
        lambda state: state.hit.cast("long"),
    )
    judged = judged.withColumn("n_hit", covered)
    return judged.select(
        "doc_id",
        "text_hash",
        "n_words",
        "n_hit",
        "items",
        "places",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
