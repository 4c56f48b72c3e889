"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are character shapes (runs of letter case, digits, marks), characters,
and how soon words return. Their TF-IDF vectors are projected on the leading
singular vectors of a bounded bank of labelled documents. The bank goes to
every task; each document's exact cosines with all of it come from blocked
matrix products, and its nearest neighbours' labels vote by similarity.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logevidence.llm.common import bounded_sample, word_batches
from logevidence.llm.sparse_terms import Counts, collect_counts, document_frequency, hashed, nonzero, overlapping, raw_texts

PREDICT_AT = 0.3
# Labelled documents in the bank at most, evenly drawn: 8,192 x 64 floats are 2 MB.
BANK = 8_192
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 20.0
PRIOR_VOTES = 0.05
BLOCK = 256

SHAPE_BITS, CHAR_BITS = 11, 10
RECENCIES = (1, 2, 4, 8, 16)  # words back
BUCKETS = (1 << SHAPE_BITS) + (1 << CHAR_BITS) + len(RECENCIES) + 1


def _shape_table() -> bytes:
    """Class of each byte: lower, upper, digit, blank, line end, marks as they are, the rest lower."""
    table = bytearray(range(256))
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.islower():
            table[b] = ord("a")
        elif c.isupper():
            table[b] = ord("A")
        elif c.isdigit():
            table[b] = ord("0")
    return bytes(table)


SHAPES = _shape_table()


def count_terms(raw: bytes) -> Counts:
    shapes, chars = np.zeros(1 << SHAPE_BITS), np.zeros(1 << CHAR_BITS)
    classes, lower = np.frombuffer(raw.translate(SHAPES), dtype=np.uint8), np.frombuffer(raw.lower(), dtype=np.uint8)
    for piece in overlapping(classes, 2):
        p = piece.astype(np.uint64)
        shapes += np.bincount(hashed(p[:-2] << np.uint64(16) | p[1:-1] << np.uint64(8) | p[2:], SHAPE_BITS), minlength=1 << SHAPE_BITS)
    for piece in overlapping(lower, 1):
        p = piece.astype(np.uint64)
        chars += np.bincount(hashed(p[:-1] << np.uint64(8) | p[1:], CHAR_BITS), minlength=1 << CHAR_BITS)
    returns = np.zeros(len(RECENCIES) + 1)
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    codes = np.concatenate([np.fromiter(map(index.__getitem__, ws), dtype=np.int32, count=len(ws)) for ws in word_batches(raw)])
    seen, last = np.zeros(len(codes), dtype=bool), 0
    for i, back in enumerate(RECENCIES):
        before = int(seen.sum())
        for k in range(last + 1, min(back, len(codes) - 1) + 1):
            seen[k:] |= codes[k:] == codes[:-k]
        returns[i], last = int(seen.sum()) - before, back
    returns[-1] = len(codes) - int(seen.sum())
    return nonzero(np.concatenate([shapes, chars, returns]))


PARTS = np.cumsum([1 << SHAPE_BITS, 1 << CHAR_BITS, len(RECENCIES) + 1])


def weighted(counts: list[Counts], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: roots of the terms' shares within each kind of term, times idf; no terms, a zero row."""
    out = np.zeros((len(counts), BUCKETS), dtype=np.float32)
    for row, (at, n) in zip(out, counts, strict=True):
        kind = np.searchsorted(PARTS, at, side="right")
        totals = np.bincount(kind, weights=n, minlength=len(PARTS))
        row[at] = np.sqrt(n / totals[kind]) * idf[at]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def leading_directions(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """About the ``k`` leading right singular vectors of x, as columns, by power rounds on a random start."""
    rng = np.random.default_rng(5)
    basis = rng.standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, rotation = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ rotation.T)[:, :k]


@dataclass
class QualityModel:
    idf: np.ndarray
    directions: np.ndarray | None
    bank: np.ndarray  # labelled vectors of unit length
    labels: np.ndarray
    share: float  # of label 1

    def vectors(self, counts: list[Counts]) -> np.ndarray:
        v = weighted(counts, self.idf) @ self.directions
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, counts: list[Counts]) -> np.ndarray:
        if self.directions is None:
            return np.full(len(counts), self.share)
        out, k = [], min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), BLOCK):
            v = self.vectors(counts[a : a + BLOCK])
            cosines = v @ self.bank.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            similar = np.take_along_axis(cosines, near, axis=1)
            weight = np.exp(SHARPNESS * (similar - 1)).astype(np.float64)
            weight /= weight.max(axis=1, keepdims=True)
            score = ((weight * self.labels[near]).sum(axis=1) + PRIOR_VOTES * self.share) / (weight.sum(axis=1) + PRIOR_VOTES)
            out.append(np.where(np.abs(v).sum(axis=1) > 0, score, self.share))
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labelled: DataFrame, limit: int = BANK) -> QualityModel:
    """``docs`` (text): document frequencies of all; ``labelled`` (doc_id, text, quality 0/1): the bank.

    Without labelled rows every score is 0.5, and with texts of no terms the
    share of label 1.
    """
    n, df = document_frequency(docs, count_terms, BUCKETS)
    idf = (np.log((n + 1) / (df + 1)) + 0.2).astype(np.float32)
    rows = bounded_sample(labelled.where("doc_id is not null and quality is not null"), limit, "doc_id")
    labels, counts = collect_counts(rows, "quality", count_terms)
    if not labels:
        return QualityModel(idf, None, np.zeros((0, 0)), np.zeros(0), 0.5)
    y = np.array([float(x) for x in labels])
    x = weighted(counts, idf)
    model = QualityModel(idf, leading_directions(x, DIMENSIONS), np.zeros((0, 0)), y, float(y.mean()))
    model.bank = model.vectors(counts)
    return model


def score_column(text: Column, model: QualityModel) -> Column:
    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        none = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32))
        raws, out = raw_texts(texts), []
        for a in range(0, len(raws), BLOCK):
            out.append(model.vote([count_terms(r) if r else none for r in raws[a : a + BLOCK]]))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return scores(text)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, score, predicted; null and empty texts score the share of label 1."""
    scored = docs.select("doc_id", score_column(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
