"""Vector column expressions: distances, scores and hashed token buckets.

Distances follow the usual vector-store conventions: ``cosine`` = 1 - cos,
``l2`` = squared Euclidean, ``ip`` = 1 - dot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Distances closer than this are treated as ties (then ordered by id) so that
# results do not depend on floating-point summation order.
ORDER_DECIMALS = 10

# Token pattern of the default hashing encoder (separators are everything else).
TOKEN_SPLIT = "[^a-z0-9/<>]+"


def _dsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _dsum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sq_norm(a: Column) -> Column:
    return _dsum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def distance(metric: str, vec: str | Column, query: Sequence[float]) -> Column:
    """Distance between each row vector and one query vector (a literal)."""
    v = col_(vec)
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        qn = sum(float(x) * float(x) for x in query) ** 0.5
        vn = F.sqrt(sq_norm(v))
        cos = F.when((vn > 0) & F.lit(qn > 0), dot(v, q) / (vn * F.lit(qn)))
        return F.coalesce(1.0 - cos, F.lit(1.0))
    if metric == "l2":
        return _dsum(F.zip_with(v, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))
    if metric == "ip":
        return 1.0 - dot(v, q)
    raise ValueError(f"unknown metric {metric!r}")


def score_of(metric: str, dist: str | Column) -> Column:
    """P-23: cosine ``1 - d``; any other metric ``1 / (1 + d)`` (null when undefined)."""
    d = col_(dist)
    if metric == "cosine":
        return 1.0 - d
    return F.try_divide(F.lit(1.0), 1.0 + d)


def order_key(dist: str | Column) -> Column:
    return F.round(col_(dist), ORDER_DECIMALS)


def token_buckets(text: str | Column, dim: int) -> Column:
    """Bucket id of every token: first 8 hex digits of md5(token), as integer, mod ``dim``."""
    toks = F.filter(F.split(F.lower(F.coalesce(col_(text), F.lit(""))), TOKEN_SPLIT, -1), lambda t: t != "")
    return F.transform(
        toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    )
