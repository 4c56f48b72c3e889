"""E-03 core: chunk text -> vectors (X-01 injection point, X-02 encoders, P-22, J-02).

Two encoder kinds plug into :func:`embed_chunks`:

* :class:`HashEncoder` (default): tokens and their md5 buckets are computed by
  JVM expressions; an Arrow-batched pandas function only turns each row's
  bucket ids into an L2-normalised count vector (one ``bincount`` per batch).
* :class:`BatchEncoder`: any ``encode_fn(list[str]) -> list[list[float]]``
  (e.g. a sentence-transformer). It runs in an iterator pandas UDF, so the
  model is built once per Python worker and fed ``batch_size`` texts at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.vectors import TOKEN_SPLIT, token_buckets
from ..schemas import EMBEDDING_FIELDS

EncodeFn = Callable[[list[str]], list[list[float]]]


def unit_count_vectors(buckets: pd.Series, dim: int) -> pd.Series:
    """Rows of bucket ids -> float32 count vectors of length ``dim`` with unit L2 norm."""
    n = len(buckets)
    if n == 0:
        return pd.Series([], dtype=object)
    arrays = [np.asarray(b if b is not None else [], dtype=np.int64) for b in buckets]
    lens = np.fromiter((a.size for a in arrays), dtype=np.int64, count=n)
    flat = np.concatenate(arrays) if lens.sum() else np.empty(0, dtype=np.int64)
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    counts = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
    norm = np.sqrt((counts * counts).sum(axis=1))
    norm[norm == 0] = 1.0
    return pd.Series(list((counts / norm[:, None]).astype(np.float32)))


_TOKEN_RE = re.compile(TOKEN_SPLIT)

# Tokens whose buckets a worker remembers, and texts encoded at a time: a worker's
# memory is that of one Arrow batch and one block, whatever the size of the input.
CACHED_TOKENS = 100_000
BLOCK_TEXTS = 256


class _Buckets(dict):
    """Buckets of the tokens that this worker remembers; a new token's is computed when it is first asked for."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, tok: str) -> int:
        if len(self) >= CACHED_TOKENS:  # bounded per-worker cache
            self.clear()
        self[tok] = b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dim
        return b


_BUCKETS: dict[int, _Buckets] = {}


def encode_texts(texts: pd.Series, dim: int) -> pd.Series:
    """The unit count vector of every text, made in blocks of :data:`BLOCK_TEXTS`."""
    out: list = []
    for a in range(0, len(texts), BLOCK_TEXTS):
        buckets = [text_buckets(t, dim) for t in texts[a : a + BLOCK_TEXTS]]
        out.extend(unit_count_vectors(pd.Series(buckets, dtype=object), dim))
    return pd.Series(out, dtype=object)


def text_buckets(text: str | None, dim: int) -> list[int]:
    """Python twin of :func:`logevidence.functions.vectors.token_buckets` (same tokens, same md5 buckets)."""
    if not text:
        return []
    tokens = _TOKEN_RE.split(text.lower())
    # Separators at the ends of a text leave an empty token there, and only there.
    if dim not in _BUCKETS:
        _BUCKETS[dim] = _Buckets(dim)
    return list(map(_BUCKETS[dim].__getitem__, tokens[not tokens[0] : len(tokens) - (not tokens[-1])]))


class HashEncoder:
    """Feature-hashing bag of tokens: bucket = first 8 hex digits of md5(token) mod dim.

    Tokens are lower-cased runs of ``[a-z0-9/<>]``. The md5 of each distinct
    token is computed once per Python worker (log text repeats its tokens).
    """

    def __init__(self, dim: int = 384, name: str | None = None):
        if dim <= 0:
            raise ValueError("dim must be > 0")
        self.dim = dim
        self.name = name or f"hash-md5-{dim}"

    def vector(self, text: str | Column) -> Column:
        dim = self.dim

        @pandas_udf(T.ArrayType(T.FloatType()))
        def _unit(texts: pd.Series) -> pd.Series:
            return encode_texts(texts, dim)

        return _unit(F.col(text) if isinstance(text, str) else text)

    def encode_local(self, texts: list[str]) -> list[list[float]]:
        """The same vectors computed in this process (for a handful of query texts)."""
        vecs = unit_count_vectors(pd.Series([text_buckets(t, self.dim) for t in texts], dtype=object), self.dim)
        return [v.tolist() for v in vecs]

    def buckets_column(self, text: str | Column) -> Column:
        """Bucket ids as a JVM expression (used to cross-check the Python path)."""
        return token_buckets(text, self.dim)


class BatchEncoder:
    """Wrap a Python batch encoder. ``factory`` builds the encode function once per worker."""

    def __init__(self, factory: Callable[[], EncodeFn], name: str, batch_size: int = 32):
        if batch_size <= 0:
            raise ValueError("batch_size must be > 0")
        self.factory = factory
        self.name = name
        self.batch_size = batch_size

    def vector(self, text: str | Column) -> Column:
        factory, bs = self.factory, self.batch_size

        @pandas_udf(T.ArrayType(T.FloatType()))
        def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = factory()
            for texts in batches:
                items = ["" if t is None else str(t) for t in texts]
                out: list = []
                for i in range(0, len(items), bs):
                    part = items[i : i + bs]
                    vecs = encode(part)
                    if len(vecs) != len(part):  # J-02: positional pairing must hold
                        raise ValueError(f"encoder returned {len(vecs)} vectors for {len(part)} texts")
                    out.extend(np.asarray(v, dtype=np.float32) for v in vecs)
                yield pd.Series(out, dtype=object)

        return _enc(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def embed_chunks(chunks: DataFrame, encoder, model_name: str | None = None) -> DataFrame:
    """P-22: embedding records (EMBEDDING layout) plus pass-through extras.

    Null text is encoded as ``""``; missing severities become an empty map.
    """
    name = model_name or encoder.name
    rec = chunks.withColumn("embedding", encoder.vector(F.coalesce(F.col("text"), F.lit(""))))
    empty_map = F.create_map().cast("map<string,int>")
    rec = rec.select(
        "chunk_id",
        "embedding",
        F.lit(name).alias("embedding_model"),
        # A constant where the encoder knows it, so that reading it doesn't run the encoder.
        (F.lit(encoder.dim) if hasattr(encoder, "dim") else F.size("embedding")).cast("int").alias("embedding_dim"),
        "source_file",
        "line_start",
        "line_end",
        "ts_start",
        "ts_end",
        F.coalesce(F.col("severities"), empty_map).alias("severities"),
        *[c for c in ("text", "sources", "backends", "source_path", "n_events") if c in chunks.columns],
    )
    return rec


__all__ = ["HashEncoder", "BatchEncoder", "embed_chunks", "unit_count_vectors", "EMBEDDING_FIELDS"]
