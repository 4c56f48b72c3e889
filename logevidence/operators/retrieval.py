"""E-05 core: filtered exact top-k search and result shaping.

T-01 search, T-02 ordering, T-03 text retrieval, T-04 batched retrieval,
F-03..F-08 filters and threshold, P-23..P-25 scores and shaping, W-04 ranks,
D-08 extra pre-filters.

Single query: the query vector is a literal, the distance a column, and
``orderBy(...).limit(k)`` becomes ``TakeOrderedAndProject`` (k rows per task).
Batched queries: the query matrix (size checked) is shipped to the tasks; each
task scores its points in blocks and keeps a running top-k per query, then a
``row_number`` per query keeps the global top-k (Spark plans it as a partial
WindowGroupLimit). No point/query pair is ever materialised as a row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import check_metric, check_threshold, check_top_k
from ..session import shared_dir
from ..schemas import SEVERITY_KEYS as SEVERITY_KEYS_CHECK
from ..functions.events import severity_counts_map
from ..functions.vectors import ORDER_DECIMALS, distance, order_key, score_of

# Largest query matrix shipped to tasks in one pass (bytes); larger batches are
# processed in several exact passes over the index.
MAX_QUERY_MATRIX_BYTES = 64 << 20


def build_where(source: str | None = None, severity: str | None = None) -> Column | None:
    """F-03..F-05: exact file filter and/or ``sev_<severity> > 0``; None when no clause."""
    clauses = []
    if source:
        clauses.append(F.col("source_file") == F.lit(source))
    if severity:
        if severity not in SEVERITY_KEYS_CHECK:
            raise ValueError(f"invalid severity {severity!r}; use one of {list(SEVERITY_KEYS_CHECK)}")
        clauses.append(F.col(f"sev_{severity}") > 0)
    if not clauses:
        return None
    out = clauses[0]
    for c in clauses[1:]:
        out = out & c
    return out


def extra_where(
    ts_from: str | None = None,
    ts_to: str | None = None,
    source_types: Sequence[str] | None = None,
    backends: Sequence[str] | None = None,
) -> Column | None:
    """D-08: time-range overlap on [ts_start, ts_end], source type and backend presence."""
    clauses = []
    if ts_from:
        clauses.append((F.col("ts_end") != "") & (F.col("ts_end") >= F.lit(ts_from)))
    if ts_to:
        clauses.append((F.col("ts_start") != "") & (F.col("ts_start") <= F.lit(ts_to)))
    if source_types:
        clauses.append(F.arrays_overlap(F.col("sources"), F.array(*[F.lit(s) for s in source_types])))
    if backends:
        clauses.append(F.arrays_overlap(F.col("backends"), F.array(*[F.lit(b) for b in backends])))
    if not clauses:
        return None
    out = clauses[0]
    for c in clauses[1:]:
        out = out & c
    return out


# Columns only needed for the k winners, never for scoring.
HEAVY = ("text", "sources", "backends")


def _narrow(points: DataFrame, where: Column | None, dim: int) -> DataFrame:
    """Filter first, then prune. A point without a vector of ``dim`` numbers is no neighbour of any query."""
    base = points if where is None else points.where(where)
    base = base.where(F.size("embedding") == dim)
    return base.select(*[c for c in points.columns if c not in HEAVY])


# Result ids that go into a pushed filter, and rows whose texts are broadcast.
MAX_PUSHED_IDS = 1_000


def search(points: DataFrame, vector: Sequence[float], top_k: int = 5, metric: str = "cosine",
           where: Column | None = None) -> DataFrame:
    """T-01: the ``top_k`` nearest points (filters first, F-06), with column ``distance``.

    Scoring reads only ids, vectors and scalar metadata; see :func:`attach_text`.
    """
    check_top_k(top_k)
    check_metric(metric)
    scored = _narrow(points, where, len(vector)).withColumn("distance", distance(metric, "embedding", vector))
    return scored.orderBy(order_key("distance"), F.col("id")).limit(top_k)


def _stored(results: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder."""
    spark = results.sparkSession
    path = shared_dir(spark, "results")
    results.write.parquet(path)
    return spark.read.schema(results.schema).parquet(path)


def attach_text(points: DataFrame, results: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Add the chunk ``text`` of the (at most k per query) result rows.

    Up to :data:`MAX_PUSHED_IDS` result ids are pushed into the index scan as
    ``id IN (...)``, so the large text column is read only near the winners, and
    the texts found are broadcast. The results of a larger batch are joined by id.
    A null id has a null text. The results are written first, as they are read twice:
    the search behind them runs once.
    """
    if "text" not in points.columns:
        return results.withColumn("text", F.lit(None).cast("string"))
    texts = points.select(F.col("id").alias(id_col), "text")
    results = _stored(results)
    ids = [r[0] for r in results.select(id_col).where(F.col(id_col).isNotNull()).distinct().limit(MAX_PUSHED_IDS + 1).collect()]
    if len(ids) > MAX_PUSHED_IDS:
        return results.join(texts, on=id_col, how="left")
    texts = texts.where(F.col(id_col).isin(sorted(ids)))
    return results.join(F.broadcast(texts), on=id_col, how="left")


def shape_results(top: DataFrame, metric: str = "cosine", score_threshold: float = 0.0,
                  by: Sequence[str] = ()) -> DataFrame:
    """P-23..P-25, F-07, T-02, W-04 on the k rows of each query.

    Threshold on the unrounded score after top-k; order by the rounded score
    (ties keep distance order, then id); rank from 1 after the threshold.
    """
    check_threshold(score_threshold)
    raw = score_of(metric, F.col("distance"))
    kept = top.withColumn("__score", raw).where(F.col("__score") >= F.lit(score_threshold))
    kept = kept.withColumn("score", F.round("__score", 4)).withColumn("__dkey", order_key("distance"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("__dkey"), F.col("id"))
    extras = [c for c in ("text", "sources", "backends") if c in top.columns]
    return kept.select(
        *by,
        F.col("id").alias("chunk_id"),
        "score",
        F.round("distance", 4).alias("distance"),
        "document",
        "source_file",
        "line_start",
        "line_end",
        F.nullif(F.col("ts_start"), F.lit("")).alias("ts_start"),
        F.nullif(F.col("ts_end"), F.lit("")).alias("ts_end"),
        severity_counts_map("sev_info", "sev_warning", "sev_error").alias("severities"),
        F.row_number().over(w).cast("int").alias("rank"),
        *extras,
        "sev_info",
        "sev_warning",
        "sev_error",
    )


def query_vector(spark: SparkSession, encoder, text: str) -> list[float]:
    """Encode one query text with the index's encoder (F-08: blank text is rejected)."""
    if text is None or not str(text).strip():
        raise ValueError("the query must not be empty")
    if hasattr(encoder, "encode_local"):  # a pure function: no job needed for one vector
        return encoder.encode_local([text])[0]
    df = spark.createDataFrame([(text,)], "text string")
    return [float(x) for x in df.select(encoder.vector(F.col("text")).alias("v")).first()["v"]]


def retrieve(spark: SparkSession, points: DataFrame, query: str, encoder, *, top_k: int = 5,
             where: Column | None = None, metric: str = "cosine", score_threshold: float = 0.0) -> DataFrame:
    """T-03: text -> vector -> filtered top-k -> shaped, ranked, cited results."""
    vec = query_vector(spark, encoder, query)
    return shape_results(search(points, vec, top_k, metric, where), metric, score_threshold)


# -- batched retrieval ---------------------------------------------------------

# Numbers of one block of distances inside a task (points x queries), and points scored at a time.
BLOCK_DISTANCES = 1 << 20
BLOCK_POINTS = 1 << 10


def _distances(mat: np.ndarray, qmat: np.ndarray, metric: str) -> np.ndarray:
    dots = mat @ qmat.T  # (points, queries)
    if metric == "cosine":
        den = np.sqrt((mat * mat).sum(axis=1))[:, None] * np.sqrt((qmat * qmat).sum(axis=1))[None, :]
        return np.where(den > 0, 1.0 - dots / np.where(den > 0, den, 1.0), 1.0)
    if metric == "l2":
        return np.maximum((mat * mat).sum(axis=1)[:, None] - 2.0 * dots + (qmat * qmat).sum(axis=1)[None, :], 0.0)
    return 1.0 - dots


def _best(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest by (rounded distance, id)."""
    key = np.round(d, ORDER_DECIMALS)
    if k < len(key):  # every row tied with the k-th key stays a candidate
        near = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
        ids, d, key = ids[near], d[near], key[near]
    order = np.lexsort((ids, key))[:k]
    return ids[order], d[order]


def _task_topk(points: DataFrame, qids: list[str], qmat: np.ndarray, k: int, metric: str) -> DataFrame:
    """Each task keeps a running top-k per query over all its batches: (query_id, id, distance)."""

    def run(batches):
        best = [(np.empty(0, dtype=object), np.empty(0)) for _ in qids]
        for pdf in batches:
            for b in range(0, len(pdf), BLOCK_POINTS):
                part = pdf[b : b + BLOCK_POINTS]
                ids, mat = part["id"].to_numpy(), np.vstack(part["embedding"].to_numpy()).astype(np.float64)
                step = max(1, BLOCK_DISTANCES // len(ids))
                for a in range(0, len(qids), step):
                    d = _distances(mat, qmat[a : a + step], metric)
                    for j in range(d.shape[1]):
                        have_ids, have_d = best[a + j]
                        best[a + j] = _best(np.concatenate([have_ids, ids]), np.concatenate([have_d, d[:, j]]), k)
        for qid, (ids, d) in zip(qids, best):
            if len(ids):
                yield pd.DataFrame({"query_id": qid, "id": ids, "distance": d})

    return points.select("id", "embedding").mapInPandas(run, "query_id string, id string, distance double")


def batch_search(points: DataFrame, queries: DataFrame, top_k: int = 5, metric: str = "cosine",
                 where: Column | None = None) -> DataFrame:
    """T-04/J-04: top-k per query for a DataFrame ``(query_id, vector)`` of query vectors.

    Queries come to the driver and go to the tasks a pass at a time, as many as
    ``MAX_QUERY_MATRIX_BYTES`` holds; a pass's winners are written before the
    next one, so the driver never holds more than one pass. Ids and distances
    alone are shuffled; the winners' metadata is joined afterwards. Queries
    without a vector, and an empty query set, have no results.
    """
    check_top_k(top_k)
    check_metric(metric)
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where(F.size("vector") > 0)
    sizes = q.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dim = sizes[1] or 0
    base = _narrow(points, where, dim)
    n_pass = max(1, -(-sizes[0] * 8 * dim // MAX_QUERY_MATRIX_BYTES))
    parts = []
    for i in range(n_pass):
        rows = (q if n_pass == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(n_pass)) == i)).collect()
        bad = [r["query_id"] for r in rows if len(r["vector"]) != dim]
        if bad:
            raise ValueError(f"query vectors differ in length: {bad[:5]}")
        found = _task_topk(base, [r["query_id"] for r in rows], np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), dim), top_k, metric)
        if n_pass > 1:
            path = shared_dir(points.sparkSession, "batch-search")
            found.write.parquet(path)
            found = points.sparkSession.read.schema(found.schema).parquet(path)
        parts.append(found)
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(order_key("distance"), F.col("id"))
    top = cand.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top_k).drop("__r")
    return top.join(base.drop("embedding"), "id")


def retrieve_many(spark: SparkSession, points: DataFrame, queries: DataFrame, encoder, *, top_k: int = 5,
                  where: Column | None = None, metric: str = "cosine", score_threshold: float = 0.0) -> DataFrame:
    """T-04: ``queries(query_id, query)`` texts -> shaped results per ``query_id``."""
    blank = F.coalesce(F.trim(F.col("query")), F.lit("")) == ""
    q = queries.where(~blank).select(
        F.col("query_id").cast("string").alias("query_id"),
        encoder.vector(F.col("query")).alias("vector"),
    )
    top = batch_search(points, q, top_k, metric, where)
    return shape_results(top, metric, score_threshold, by=["query_id"])
