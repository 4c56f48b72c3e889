"""Toxicity by maximum-scoring segments of token log-odds.

A word's score is the log-odds of its longest known piece (the word or its
first 4 to 7 characters) between toxic and other text under Dirichlet priors,
less a drift that makes ordinary text score below zero. A linear scan finds
every maximal scoring segment; extreme-value theory says how likely ordinary
text of that length is to have such a segment, and that significance is
calibrated to a probability on labelled documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logevidence.llm.common import bounded_sample, word_batches

PREDICT_AT = 0.7
# Labelled documents that the model is fitted on, at most (evenly drawn).
FIT_DOCUMENTS = 20_000
# A piece is in the model from this significance on. That takes some MIN_Z**2 / 2 contexts among the sample's, so the
# sample bounds the model: by a fraction of its distinct contexts.
MIN_Z = 5.0
PRIOR_WEIGHT = 1_000.0
MIN_LOG_ODDS = 1.0
MAX_LOG_ODDS = 8.0
DRIFT = 0.5
PIECE_CHARS = (4, 5, 6, 7)
KARLIN_K = 0.1
SIGNIFICANT_P = 0.01
CACHE_WORDS = 200_000

PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def normal(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(PUNCTUATION)


def pieces(word: str) -> list[str]:
    """A word and its beginnings, longest first; a beginning is marked, as it isn't that word."""
    return [word, *(word[:n] + "-" for n in reversed(PIECE_CHARS) if len(word) > n)]


@dataclass
class ToxicityModel:
    scores: dict[str, float]  # piece -> log-odds less drift
    rate: float  # lambda of the extreme-value distribution
    slope: float
    intercept: float


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score) by the linear-time scan of Ruzzo and Tompa."""
    runs = np.flatnonzero(scores > 0)
    if not len(runs):
        return []
    before = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    # first, past, sum before, sum at its end, place of the last one before with a lower sum before
    stack: list[tuple[int, int, float, float, int]] = []
    for i in runs.tolist():
        first, past, left, right = i, i + 1, before[i], before[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, past, left, right, j))
    return [(a, b, r - x) for a, b, x, r, _ in stack]


class WordScores(dict):
    """Scores by raw word; emptied when it has CACHE_WORDS, so its memory is bounded."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, raw: bytes) -> float:
        known = self.model.scores
        score = next((known[p] for p in pieces(normal(raw)) if p in known), -DRIFT)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[raw] = score
        return score


def passages(raw: bytes | None, scores: WordScores) -> tuple[int, list[tuple[int, int, float, float]]]:
    """Word count and scoring segments (first word, past the last, score, p-value), whole text."""
    if not raw:
        return 0, []
    values = np.concatenate([np.fromiter(map(scores.__getitem__, ws), dtype=np.float64, count=len(ws)) for ws in word_batches(raw)])
    n, rate = len(values), scores.model.rate
    return n, [(a, b, s, -math.expm1(-KARLIN_K * n * math.exp(-rate * s))) for a, b, s in segments(values)]


def extremeness(n: int, found: list[tuple[int, int, float, float]], rate: float) -> float:
    """The segments as one Gumbel variate: under ordinary text, standard for the best one.

    Further segments add what they exceed the expected best by.
    """
    if not found:
        return -3.0
    x = sorted((rate * s - math.log(KARLIN_K * n) for _, _, s, _ in found), reverse=True)
    return max(-3.0, min(40.0, x[0] + sum(max(0.0, v) for v in x[1:])))


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return [x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(name).cast(pa.binary())]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (word, next word, toxic) of the texts."""
    for batch in batches:
        seen: set[tuple[str, str, int]] = set()
        for raw, toxic in zip(_texts(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
            last = None
            for ws in word_batches(raw or b""):
                words = [normal(w) for w in ws]
                if last is not None:
                    words.insert(0, last)
                seen.update((a, b, toxic) for a, b in zip(words, words[1:], strict=False))
                last = words[-1] if words else last
            if last is not None:
                seen.add((last, "", toxic))
        rows = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([hash_32(r[1]) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
            names=["word", "next", "toxic"],
        )


def hash_32(text: str) -> int:
    return zlib.crc32(text.encode()) - (1 << 31)


def _pieces_column(word: Column) -> Column:
    beginnings = [F.when(F.char_length(word) > n, F.concat(F.left(word, F.lit(n)), F.lit("-"))) for n in PIECE_CHARS]
    return F.array_compact(F.array(word, *beginnings))


def _rate(y: list[tuple[float, float]]) -> float:
    """Lambda with sum(p * exp(lambda * s)) = 1 over ordinary tokens (p, s)."""
    p, s = np.array(y).T
    low, high = 1e-3, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-dimensional logistic regression with a weak prior."""
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -3, 3))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def fit(labelled: DataFrame, limit: int = FIT_DOCUMENTS) -> ToxicityModel:
    """``labelled`` (doc_id, text, toxic 0/1) -> model, from ``limit`` rows at most.

    Tokens are counted by distinct context (word and next word), so copies and
    repeated passages count once. Without rows of both labels no piece is
    known, and every score is the share of toxic rows.
    """
    rows = bounded_sample(labelled.where("doc_id is not null and toxic is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), limit, "doc_id")
    # Pieces are learned from three parts of the rows, the calibration from the fourth.
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    words = (
        rows.where(~calibrates).select("text", "toxic").mapInArrow(_contexts, "word string, next int, toxic int").distinct()
        .groupBy("word").agg(F.sum(F.col("toxic")).alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    )
    counted = words.withColumn("piece", F.explode(_pieces_column(F.col("word")))).groupBy("piece").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    totals = words.agg(F.coalesce(F.sum("y1"), F.lit(0)), F.coalesce(F.sum("y0"), F.lit(0))).first()
    n1, n0 = float(totals[0]), float(totals[1])
    if not n1 or not n0:
        share = rows.agg(F.avg("toxic")).first()[0] or 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return ToxicityModel({}, 1.0, 0.0, math.log(share / (1 - share)))
    # The prior is the piece's share of all text, worth PRIOR_WEIGHT tokens.
    prior = PRIOR_WEIGHT * (F.col("y1") + F.col("y0")) / (n1 + n0)
    one, nil = F.col("y1") + prior, F.col("y0") + prior
    odds = F.log(one / (n1 + PRIOR_WEIGHT - one)) - F.log(nil / (n0 + PRIOR_WEIGHT - nil))
    # Significance is the root of the likelihood ratio: sound for counts of 0.
    expected = (F.col("y1") + F.col("y0")) / (n1 + n0)

    def term(seen: Column, of: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (expected * of))).otherwise(0.0)

    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (term(F.col("y1"), n1) + term(F.col("y0"), n0))))
    known = (
        counted.select("piece", odds.alias("odds"), z.alias("z"), (nil / (n0 + PRIOR_WEIGHT)).alias("p0"))
        .where((F.col("z") >= MIN_Z) & (F.abs("odds") >= MIN_LOG_ODDS))
        .orderBy(F.col("z").desc(), "piece")
        .collect()
    )
    scores = {r.piece: min(r.odds, MAX_LOG_ODDS) - DRIFT for r in known}
    weights = [(r.p0, scores[r.piece]) for r in known if scores[r.piece] > 0]
    model = ToxicityModel(scores, _rate([*weights, (max(0.1, 1 - sum(p for p, _ in weights)), -DRIFT)]) if weights else 1.0, 0.0, 0.0)
    held = rows.where(calibrates).select(extremes_column(F.col("text"), model).alias("x"), "toxic").toPandas()
    model.slope, model.intercept = _logistic(held.x.to_numpy(float), held.toxic.to_numpy(float))
    return model


def extremes_column(text: Column, model: ToxicityModel) -> Column:
    @F.arrow_udf("double")
    def extremes(texts: pa.Array) -> pa.Array:
        scores = WordScores(model)
        found = (passages(x.as_buffer().to_pybytes() if x.is_valid else None, scores) for x in texts.cast(pa.binary()))
        return pa.array([extremeness(n, s, model.rate) for n, s in found], pa.float64())

    return extremes(text)


PASSAGES = "array<struct<first_word: int, past_word: int, log_odds: double, p_value: double>>"


def passages_column(text: Column, model: ToxicityModel) -> Column:
    """struct(extreme double, passages): every segment with a p-value of SIGNIFICANT_P or less."""

    @F.arrow_udf(f"struct<extreme: double, passages: {PASSAGES}>")
    def found(texts: pa.Array) -> pa.Array:
        scores, rows = WordScores(model), []
        for x in texts.cast(pa.binary()):
            n, segs = passages(x.as_buffer().to_pybytes() if x.is_valid else None, scores)
            rows.append((extremeness(n, segs, model.rate), [s for s in segs if s[3] <= SIGNIFICANT_P]))
        spans = pa.struct([("first_word", pa.int32()), ("past_word", pa.int32()), ("log_odds", pa.float64()), ("p_value", pa.float64())])
        keys = [f.name for f in spans]
        return pa.StructArray.from_arrays(
            [pa.array([e for e, _ in rows], pa.float64()), pa.array([[dict(zip(keys, s, strict=True)) for s in p] for _, p in rows], pa.list_(spans))],
            names=["extreme", "passages"],
        )

    return found(text)


def _probability(extreme: Column, model: ToxicityModel) -> Column:
    return 1 / (1 + F.exp(-(model.slope * extreme + model.intercept)))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, score, predicted, passages. Null and empty texts have no passage."""
    found = docs.select("doc_id", passages_column(F.col("text"), model).alias("_t"))
    score = _probability(F.col("_t.extreme"), model)
    return found.select("doc_id", score.alias("score"), (score >= PREDICT_AT).cast("int").alias("predicted"), F.col("_t.passages").alias("passages"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents scored below PREDICT_AT, with all their columns."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    scored = packed.select("_row", extremes_column(F.col("_row.text"), model).alias("_x"))
    return scored.where(_probability(F.col("_x"), model) < PREDICT_AT).select("_row.*")
