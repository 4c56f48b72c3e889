"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams, document
frequencies counted over all documents. Weights are trained with the
follow-the-regularised-leader (proximal) rule with elastic-net penalties, in
turn over a bounded sample; a temperature fitted on rows apart from those
calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logevidence.llm.sparse_terms import Counts, collect_counts, document_frequency, hashed, nonzero, overlapping, raw_texts

UNDETERMINED = "und"
# Labelled documents that the model is trained on at most: half of them dealt
# evenly to the languages, half by the languages' shares of the rows.
FIT_DOCUMENTS = 8_000
BITS = 14
ORDERS = (1, 2, 3)
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.01

LETTER = re.compile(r"[^\W\d_]")


def count_grams(raw: bytes) -> Counts:
    chars = np.frombuffer(raw.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    total = np.zeros(1 << BITS)
    for n in ORDERS:
        for piece in overlapping(chars, n - 1):
            p = piece.astype(np.uint64)
            if len(p) >= n:
                grams = np.full(len(p) - n + 1, n, dtype=np.uint64)
                for k in range(n):
                    grams = grams << np.uint64(20) ^ p[k : k + len(grams)]
                total += np.bincount(hashed(grams, BITS), minlength=1 << BITS)
    return nonzero(total)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # gram x language, then the intercept
    temperature: float = 1.0

    def features(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts
        x = (1 + np.log(n)) * self.idf[at]
        return np.append(at, len(self.idf)), np.append(x / max(float(np.linalg.norm(x)), 1e-9), 1.0)

    def logits(self, counts: Counts) -> np.ndarray:
        at, x = self.features(counts)
        return x @ self.weights[at]

    def probabilities(self, counts: Counts) -> np.ndarray:
        return softmax(self.logits(counts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(model: LanguageModel, counts: list[Counts], y: np.ndarray, epochs: int = EPOCHS) -> None:
    """FTRL-proximal: per weight a sum of gradients and of their squares; the
    elastic net keeps a weight at zero until its gradients exceed L1."""
    shape = (len(model.idf) + 1, len(model.languages))
    z, n = np.zeros(shape), np.zeros(shape)

    def current(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    rows = [model.features(c) for c in counts]
    for _ in range(epochs):
        for (at, x), label in zip(rows, y.tolist(), strict=True):
            w = current(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            squared = g * g
            z[at] += g - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squared
    model.weights = current(np.arange(shape[0])).astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The temperature with the least log loss (golden-section search on its logarithm)."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(np.average(-np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12), weights=weights))

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sample_by_language(known: DataFrame, limit: int) -> tuple[DataFrame, dict[str, int]]:
    """About ``limit`` rows at most of ``known`` (doc_id, text, lang), and the rows of each language.

    Each language has its part of the rows, all of them where it has no more,
    drawn by a hash of doc_id. One row per language comes here.
    """
    rows = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    n = sum(rows.values())
    if n <= limit:
        return known, rows
    parts = [(x, min(1 << 30, int(limit / 2 * (1 / len(rows) / k + 1 / n) * (1 << 30)))) for x, k in rows.items()]
    below = known.sparkSession.createDataFrame(parts, "lang string, _below long")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < F.col("_below")
    return known.join(F.broadcast(below), "lang").where(drawn).select("doc_id", "text", "lang"), rows


def fit(docs: DataFrame, labelled: DataFrame, limit: int = FIT_DOCUMENTS) -> LanguageModel:
    """``docs`` (text): document frequencies of all; ``labelled`` (doc_id, text, lang).

    Rows without a language or a text teach nothing. A quarter of the sample
    is kept for the temperature; a row there weighs as many rows as it stands
    for. Without labelled rows no language is known
    and every text is undetermined.
    """
    n, df = document_frequency(docs, count_grams, 1 << BITS)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.1
    known = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sample, rows = sample_by_language(known, limit)
    labels, counts = collect_counts(sample, "lang", count_grams)
    model = LanguageModel(sorted(set(labels)), idf)
    if labels:
        y = np.array([model.languages.index(x) for x in labels])
        kept = max(1, len(y) * 3 // 4)
        train(model, counts[:kept], y[:kept])
        drawn = Counter(labels)
        stands_for = np.array([rows[x] / drawn[x] for x in labels[kept:]])
        model.temperature = fit_temperature(np.array([model.logits(c) for c in counts[kept:]]).reshape(-1, len(model.languages)), y[kept:], stands_for)
    return model


def language_column(text: Column, model: LanguageModel) -> Column:
    """struct(lang, score); a null text or one without a letter is undetermined, with score 0."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def languages(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for raw in raw_texts(texts):
            if not raw or not model.languages or not LETTER.search(raw.decode("utf-8", "replace")):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            p = model.probabilities(count_grams(raw))
            names.append(model.languages[int(p.argmax())])
            scores.append(float(p.max()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return languages(text)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, lang_pred, score."""
    found = docs.select("doc_id", language_column(F.col("text"), model).alias("_l"))
    return found.select("doc_id", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))
