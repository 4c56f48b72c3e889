"""D-01..D-04: chunk histograms, relevance labels, precision@k and phenomenon counts.

Relevance rubric: for each retrieved chunk, the share of its events matching the
query's phenomenon predicate decides the label (R >= 50 %, P > 0, N absent),
weighted 1 / 0.5 / 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RELEVANCE_WEIGHTS
from ..functions.text import base_name, path_stem
from .chunking import explode_to_chunks, positioned_events


def chunk_membership(events: DataFrame, chunk_size: int, chunk_overlap: int, key: str | None = None) -> DataFrame:
    """Every event tagged with the ``chunk_id`` of each window holding it."""
    key = key or ("source_path" if "source_path" in events.columns else "source_file")
    ex = explode_to_chunks(positioned_events(events, key), chunk_size, chunk_overlap)
    return ex.withColumn(
        "chunk_id", F.concat(path_stem(base_name(F.col(key))), F.lit("-"), F.col("chunk_index").cast("string"))
    )


def chunk_histograms(members: DataFrame) -> DataFrame:
    """D-01: per chunk, event counts by status code and by method (``dimension, value, n``)."""
    st = members.groupBy("chunk_id", F.col("status_code").cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("dimension", F.lit("status"))
    me = members.groupBy("chunk_id", F.col("method").alias("value")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("dimension", F.lit("method"))
    return st.unionByName(me).select("chunk_id", "dimension", "value", "n")


def predicate_by_query(predicates: Sequence[tuple[str, str]]) -> Column:
    """CASE over ``query_id`` evaluating each query's SQL predicate on event columns."""
    out = None
    for qid, pred in predicates:
        cond = F.coalesce(F.expr(pred), F.lit(False))
        out = F.when(F.col("query_id") == qid, cond) if out is None else out.when(F.col("query_id") == qid, cond)
    return out.otherwise(F.lit(False))


def relevance_labels(results: DataFrame, members: DataFrame, predicates: Sequence[tuple[str, str]]) -> DataFrame:
    """D-02: label each (query, retrieved chunk) from the real events of the chunk.

    ``results`` has at most k rows per query, so it is the small side of the join.
    """
    hits = results.select("query_id", "rank", "chunk_id")
    joined = members.join(hits, on="chunk_id", how="inner")
    agg = joined.groupBy("query_id", "rank", "chunk_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(predicate_by_query(predicates)).alias("n_match"),
    )
    share = F.col("n_match") / F.col("n_events")
    label = F.when(share >= 0.5, "R").when(share > 0, "P").otherwise("N")
    w = F.create_map(*[x for k, v in RELEVANCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return agg.select(
        "query_id", "rank", "chunk_id", "n_events", "n_match", F.round(share, 4).alias("share"),
        label.alias("label"), F.element_at(w, label).alias("weight"),
    )


def precision_at_k(labels: DataFrame, k: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """D-03: P@1 strict / R-or-P / weighted, P@k weighted and success@k over all queries.

    ``queries`` (query_id) lists the queries asked: one without a result counts
    as a miss. Without it only queries that have labels are known.
    """
    if queries is not None:
        labels = queries.select("query_id").distinct().join(labels, "query_id", "left")
    per_q = labels.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("l1"),
        F.max(F.when(F.col("rank") == 1, F.col("weight"))).alias("w1"),
        F.sum(F.when(F.col("rank") <= k, F.col("weight"))).alias("wk"),
        F.max(F.when((F.col("rank") <= k) & F.col("label").isin("R", "P"), 1).otherwise(0)).alias("hit"),
    )
    return per_q.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.when(F.col("l1") == "R", 1.0).otherwise(0.0)), 4).alias("p1_strict"),
        F.round(F.avg(F.when(F.col("l1").isin("R", "P"), 1.0).otherwise(0.0)), 4).alias("p1_r_or_p"),
        F.round(F.avg(F.coalesce(F.col("w1"), F.lit(0.0))), 4).alias("p1_weighted"),
        F.round(F.avg(F.coalesce(F.col("wk"), F.lit(0.0)) / k), 4).alias(f"p{k}_weighted"),
        F.round(F.avg(F.col("hit").cast("double")), 4).alias(f"success{k}"),
    )


def phenomenon_counts(events: DataFrame, phenomena: Sequence[tuple[str, str]]) -> DataFrame:
    """D-04: one pass of ``count_if`` per predicate, unpivoted to ``phenomenon, n_events``."""
    aggs = [F.count_if(F.coalesce(F.expr(p), F.lit(False))).alias(name) for name, p in phenomena]
    wide = events.agg(F.count(F.lit(1)).alias("all_events"), *aggs)
    names = ["all_events", *[n for n, _ in phenomena]]
    stack = "stack({}, {}) as (phenomenon, n_events)".format(
        len(names), ", ".join(f"'{n}', `{n}`" for n in names))
    return wide.selectExpr(stack)
