"""Row ordinals inside a group without a whole-group window.

``row_number() over (partition by key order by o)`` puts a whole group into one
task; one log file can hold a third of all lines. Here the order column is cut
into fixed-width buckets: a window only ever spans one (key, bucket) slice, and
the slices are stitched together with an exclusive prefix sum over the small
per-slice count table (one row per slice, i.e. rows / width at most).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 16


def ordinal_within(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    out: str = "pos",
    width: int = DEFAULT_WIDTH,
    total: str | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based rank of ``order_col`` inside ``keys`` (values unique per key).

    With ``total`` set, also add the group size. ``order_col`` must be integral.
    No row is dropped: null keys are a group, and rows without an order value
    come before the others of their group, in slices dealt by a hash of the row.
    """
    k, b = "__key", "__slice"
    unordered = F.lit(-(1 << 62)) + F.pmod(F.xxhash64(*df.columns), F.lit(64))
    # A struct of the keys is never null, so groups with null keys join like any other.
    sliced = df.select(
        "*", F.struct(*(F.col(c) for c in keys)).alias(k), F.coalesce(F.floor(F.col(order_col) / F.lit(width)), unordered).alias(b))
    counts = sliced.groupBy(k, b).agg(F.count(F.lit(1)).alias("__n"))
    w_prev = Window.partitionBy(k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(
        k, b, F.coalesce(F.sum("__n").over(w_prev), F.lit(0)).alias("__off"),
        *([F.sum("__n").over(Window.partitionBy(k)).alias(total)] if total else []),
    )
    ranked = sliced.select("*", F.row_number().over(Window.partitionBy(k, b).orderBy(order_col)).alias("__rn"))
    # The offsets side has one row per slice; AQE measures it after its shuffle
    # and broadcasts it only when it is actually small (else the window output,
    # already partitioned on the join keys, is joined without a new shuffle).
    joined = ranked.join(offs, on=[k, b], how="inner")
    return joined.select(
        *df.columns, (F.col("__off") + F.col("__rn") - 1).cast("long").alias(out), *([total] if total else []))
