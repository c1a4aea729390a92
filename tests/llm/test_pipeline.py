"""The pipeline against the operators' definitions applied one text at a time."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from fleetlens.llm.common import in_fold
from fleetlens.llm.secrets import TypeCache, find_spans, redact
from fleetlens.llm.secrets import train as train_secrets
from fleetlens.llm.sentence_pieces import Pieces, encode_text
from fleetlens.llm.toxicity import train_toxicity
from pyspark.sql import functions as F
from tests.llm.test_operators import brute_links, texts, words_in

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def contaminated(text, windows):
    words, hit = words_in(text), set()
    for i in range(len(words)):
        for n in {len(w) for w in windows}:
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def brute_force(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(~in_fold(F.col("doc_id"), 3, 1))
    model = train_toxicity(docs, labels)
    rows = [r for r in docs.collect() if model.score(r.text or "")[0] < 0.7]
    groups = brute_links([(r.doc_id, r.text) for r in rows])
    first = {(doc_id, class_id) for doc_id, class_id, _ in groups}
    kept = {doc_id for doc_id, class_id in first if doc_id == class_id}
    seen, single = set(), []
    for row in rows:
        if row.doc_id is None or row.doc_id in kept and (row.doc_id, row.text) not in seen:
            single.append(row)
            seen.add((row.doc_id, row.text))
    windows = set()
    for item in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words_in(item.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = [r for r in single if not contaminated(r.text, windows)]
    field = train_secrets(spark.createDataFrame([tuple(r) for r in clean], COLUMNS))
    cache = TypeCache(field) if field else None
    pieces = Pieces.load()
    out = Counter()
    for row in clean:
        text = row.text or ""
        text = redact(text, [(a, b) for a, b, _ in sum(find_spans(text, field, cache), [])])
        out[row.doc_id, tuple(encode_text(text, pieces).tolist()), text] += 1
    return out


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = Counter((r.doc_id, tuple(r.pieces), r.text) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == brute_force(spark, docs)
    assert 0 < sum(got.values()) < docs.count()


def test_stages_on_hard_rows(spark):
    rows = [(i * 3 + 1, t, "en", "s", None) for i, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    want = brute_force(spark, docs)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            docs = spark.createDataFrame(after.collect(), COLUMNS)
    assert Counter((r.doc_id, tuple(r.pieces), r.text) for r in after.collect()) == want


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []


def test_the_secret_stage_keeps_every_column(spark):
    """Columns named like the stage's own, and documents without a character count."""
    kinds = "doc_id long, text string, text_before string, text_before_ string, n_chars int"
    rows = [(1, "password=abcdefgh12 x", "KEEPME", "AND ME", 21), (2, "plain", None, "x", 5), (3, None, "y", None, None)]
    docs = spark.createDataFrame(rows, kinds)
    found = {r.doc_id: r for r in corpus_pipeline.hide_secrets(spark, docs, SMALL).collect()}
    assert found[1].text_before == "KEEPME" and found[1].text_before_ == "AND ME"
    assert "abcdefgh12" not in found[1].text and found[1].n_chars == len(found[1].text)
    assert (found[2].text, found[2].text_before, found[2].n_chars) == ("plain", None, 5)
    bare = corpus_pipeline.hide_secrets(spark, docs.drop("n_chars"), SMALL)
    assert bare.columns == ["doc_id", "text", "text_before", "text_before_"] and bare.count() == 3
