"""Hashed term counts of texts, their document frequencies, and samples of them.

A counter maps a text's bytes to the counts of its terms (places in a fixed
number of buckets, and how often), whole text, in time linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logevidence.llm.common import PIECE_BYTES

Counts = tuple[np.ndarray, np.ndarray]
Counter = Callable[[bytes], Counts]

NO_TERMS: Counts = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32))


def raw_texts(column: pa.Array) -> list[bytes | None]:
    return [x.as_buffer().to_pybytes() if x.is_valid else None for x in column.cast(pa.binary())]


def overlapping(values: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    """``values`` in pieces of bounded size, each with the last ``overlap`` of the one before."""
    for start in range(0, max(len(values), 1), PIECE_BYTES):
        yield values[max(0, start - overlap) : start + PIECE_BYTES]


def hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit code."""
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def nonzero(total: np.ndarray) -> Counts:
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def document_frequency(texts: DataFrame, counter: Counter, buckets: int) -> tuple[int, np.ndarray]:
    """``texts`` (text) -> rows, and of each bucket the rows that have it; over all rows.

    A task adds its rows up first, so it sends one count a bucket.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, dtype=np.int64)
        for batch in batches:
            for raw in raw_texts(batch.column("text")):
                total[buckets] += 1
                if raw:
                    total[counter(raw)[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(added, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets + 1, dtype=np.int64)
    for r in rows:
        total[r.bucket] = r.n
    return int(total[buckets]), total[:buckets]


def collect_counts(rows: DataFrame, label: str, counter: Counter) -> tuple[list, list[Counts]]:
    """Labels and term counts of a bounded sample (text, label); in order of a
    hash of the row, so that training on it in turn is training in random order."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counter(raw) if raw else NO_TERMS for raw in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("at"), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([y for _, y in found], pa.list_(pa.float32()))],
                names=["label", "at", "terms", "counts"],
            )

    shown = rows.select("text", F.col(label).cast("string").alias("label"), F.xxhash64("text", label).alias("at"))
    got = shown.mapInArrow(counted, "label string, at long, terms array<int>, counts array<float>").toPandas().sort_values(["at", "label"])
    return got["label"].tolist(), [(np.asarray(t, dtype=np.int32), np.asarray(c, dtype=np.float32)) for t, c in zip(got["terms"], got["counts"], strict=True)]
