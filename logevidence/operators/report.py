"""A-12: corpus report - lines, events, chunks and embeddings per file, plus totals.

Two aggregates, one row per file each: lines and events from the classified
lines, chunks and embeddings from the embedding records (which carry the file
path through). They are outer-joined on the path; the total row is folded from
the per-file rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMS = ("lines", "events", "chunks", "embeddings")


def corpus_report(classified: DataFrame, records: DataFrame, on_parse_error: str = "skip") -> DataFrame:
    key = "source_path"
    kept = ["ok", "error"] if on_parse_error == "keep" else ["ok"]
    le = classified.groupBy(key, "source_file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status").isin(*kept)).alias("events"))
    ce = records.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embeddings"))
    per = le.join(ce, key, "left").select(
        key, "source_file", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in NUMS])
    total = per.agg(F.count(F.lit(1)).alias("files"),
                    *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in NUMS])
    return per.select(
        key, "source_file", F.lit(1).cast("long").alias("files"), *NUMS, F.lit(False).alias("is_total")
    ).unionByName(
        total.select(F.lit(None).cast("string").alias(key), F.lit(None).cast("string").alias("source_file"),
                     "files", *NUMS, F.lit(True).alias("is_total"))
    )
