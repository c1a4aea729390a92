"""Toxicity by multiple-instance learning: sentence scores, noisy-or, document labels.

Only documents are labelled.  A document is toxic if any of its sentences is, or by a leak
that stands for labels no sentence explains:

    p(document) = 1 - (1 - leak) * prod over sentences (1 - p(sentence))
    p(sentence) = 1 - exp(-sum of the weights of its distinct words)

Weights are not negative, so a sentence without weighted words has probability 0, and the
weights that explain a document compete with each other.  They are fitted by projected
gradient steps with an L1 penalty on a bounded sample of the labelled rows (``SAMPLE``,
chosen by a hash of the text); scoring reads every whole text.

Defined results: null and empty texts have no sentences and score the leak; documents
without a label are scored like the others; null labels are not learned from; repeated rows
are scored row by row and learned from once; without any label of either kind no word has a
weight.  Other columns, also ``toxic`` ones in the documents, are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_hash, clean_text, give_back, giving_back, known_id, real_id

#: At most about this many labelled rows are learned from.
SAMPLE = 12_000
THRESHOLD = 0.7
MIN_DOCS = 3
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class ToxicityModel:
    """``weights`` by word, and the leak."""

    leak: float
    weights: dict[str, float] = field(default_factory=dict)

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """``(start, end, probability)`` of the sentences with a weighted word."""
        found = []
        for match in _SENTENCE.finditer(text):
            words = set(_WORD.findall(match[0].lower()))
            total = math.fsum(self.weights[word] for word in sorted(words & self.weights.keys()))
            if total > 0:
                found.append((match.start(), match.end(), 1 - math.exp(-total)))
        return found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a document and its sentences with a weighted word."""
        if self.weights.keys().isdisjoint(_WORD.findall(text.lower())):
            return self.leak, []
        found = self.sentences(text)
        clean = math.prod(1 - p for _, _, p in found)
        return 1 - (1 - self.leak) * clean, found


def _candidates(texts: list[str], labels: np.ndarray) -> list[str]:
    """Words seen more often in toxic documents than chance explains (z > 4)."""
    toxic, rest = Counter(), Counter()
    for text, label in zip(texts, labels):
        (toxic if label else rest).update(set(_WORD.findall(text.lower())))
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    chosen = []
    for word, k in toxic.items():
        other = rest[word]
        share = (k + other) / (n1 + n0)
        spread = math.sqrt(share * (1 - share) * n1) or 1.0
        if k >= MIN_DOCS and (k - share * n1) / spread > 4 and k / n1 > 2 * (other + 0.5) / (n0 + 1):
            chosen.append(word)
    return sorted(chosen)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 600, penalty: float = 0.2) -> ToxicityModel:
    """Weights that maximise the likelihood of the document labels, less ``penalty * sum(weights)``.

    With weights as rates, the noisy-or over sentences is one exponential: a document is
    clean with probability (1 - leak) * exp(-sum over sentences and their words).
    """
    labels = np.asarray(labels, dtype=float)
    if not len(labels) or labels.sum() in (0, len(labels)):
        return ToxicityModel(float(labels.mean()) if len(labels) else 0.0)
    words = _candidates(texts, labels)
    index = {word: i for i, word in enumerate(words)}
    rows, columns = [], []
    for at, text in enumerate(texts):
        if index.keys().isdisjoint(_WORD.findall(text.lower())):
            continue
        for match in _SENTENCE.finditer(text):
            hit = [index[w] for w in set(_WORD.findall(match[0].lower())) if w in index]
            rows += [at] * len(hit)
            columns += hit
    rows, columns = np.array(rows, dtype=int), np.array(columns, dtype=int)
    weights, leak = np.full(len(words), 0.5), float(labels.mean()) / 2
    speed = np.zeros(len(words))
    for _ in range(rounds):
        rate = np.bincount(rows, weights[columns], len(texts)) - math.log1p(-leak)
        toxic = np.maximum(1 - np.exp(-rate), 1e-9)
        # d log-likelihood / d rate: exp(-r)/(1-exp(-r)) for label 1, -1 for label 0.
        slope = np.where(labels > 0, (1 - toxic) / toxic, -1.0)
        gradient = np.bincount(columns, slope[rows], len(words)) - penalty
        speed = 0.9 * speed + 0.1 * gradient**2
        weights = np.clip(weights + 0.05 * gradient / (np.sqrt(speed) + 1e-6), 0, 8)
        # The leak explains labels where no word does: the share of label 1 given its blame.
        blame = labels * np.where(rate > 0, leak / toxic, 0)
        leak = float(np.clip(blame.mean(), 1e-4, 0.5))
    kept = {word: round(float(w), 6) for word, w in zip(words, weights) if w > 0.05}
    return ToxicityModel(round(leak, 6), kept)


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(text, label)``: at most about ``sample`` distinct labelled texts, chosen by hash."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    total = marks.count()
    share = min(1.0, sample / max(total, 1))
    # The hash of the id decides before texts are read into the join.
    kept = marks.where(by_hash(share, "doc_id"))
    docs = documents.select("doc_id", clean_text(F.col("text")).alias("text"))
    return docs.join(kept, "doc_id").groupBy("text").agg(F.max("label").alias("label"))


def train_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit in one task: its input is bounded by ``sample`` whatever the corpus size."""
    rows = training_rows(documents, labels, sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        parts = list(frames)
        data = pd.concat(parts) if parts else pd.DataFrame({"text": [], "label": []})
        data = data.sort_values("text", ignore_index=True)
        model = fit(data["text"].tolist(), data["label"].to_numpy())
        parts = data = None
        give_back()
        yield pd.DataFrame({"word": ["", *model.weights], "weight": [model.leak, *model.weights.values()]})

    found = rows.coalesce(1).mapInPandas(run, "word string, weight double").collect()
    table = {row.word: row.weight for row in found}
    return ToxicityModel(table.pop("", 0.0), table)


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, score, predicted`` and ``sentences``, the offending ones.

    A sentence offends if its own probability reaches ``threshold``; starts and ends are
    code points.
    """
    schema = "doc_id long, text_hash long, score double, predicted int, sentences array<struct<start:int,end:int,p:double>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scored = [model.score(text) for text in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "text_hash": frame["text_hash"],
                    "score": [score for score, _ in scored],
                    "predicted": [int(score >= threshold) for score, _ in scored],
                    "sentences": [
                        [{"start": a, "end": b, "p": p} for a, b, p in found if p >= threshold] for _, found in scored
                    ],
                }
            )

    docs = documents.select(
        known_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("text_hash"), clean_text(F.col("text")).alias("text")
    )
    found = docs.mapInPandas(giving_back(run), schema)
    return found.select(real_id("doc_id"), "text_hash", "score", "predicted", "sentences")


def keep_clean(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``documents``, all columns, that score below ``threshold``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(text)[0] for text in texts], dtype=float)
        texts = None
        give_back()

    return documents.where(score(clean_text(F.col("text"))) < threshold)
