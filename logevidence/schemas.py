"""Closed schemas of every table the library reads or writes.

Column order is part of the contract: writers always ``select(*NAMES)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_FIELDS = (
    "timestamp",
    "source",
    "severity",
    "client_ip",
    "method",
    "path",
    "status_code",
    "bytes",
    "duration_ms",
    "backend",
    "source_file",
    "line_number",
    "raw",
)

EVENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType(), True),
        T.StructField("source", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("client_ip", T.StringType(), True),
        T.StructField("method", T.StringType(), True),
        T.StructField("path", T.StringType(), True),
        T.StructField("status_code", T.IntegerType(), True),
        T.StructField("bytes", T.LongType(), True),
        T.StructField("duration_ms", T.LongType(), True),
        T.StructField("backend", T.StringType(), True),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("line_number", T.LongType(), False),
        T.StructField("raw", T.StringType(), False),
    ]
)

CHUNK_FIELDS = (
    "chunk_id",
    "source_file",
    "sources",
    "line_start",
    "line_end",
    "ts_start",
    "ts_end",
    "n_events",
    "severities",
    "event_lines",
    "text",
)

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("source_file", T.StringType(), True),
        T.StructField("sources", T.ArrayType(T.StringType()), True),
        T.StructField("line_start", T.LongType(), True),
        T.StructField("line_end", T.LongType(), True),
        T.StructField("ts_start", T.StringType(), True),
        T.StructField("ts_end", T.StringType(), True),
        T.StructField("n_events", T.IntegerType(), True),
        T.StructField("severities", T.MapType(T.StringType(), T.IntegerType()), True),
        T.StructField("event_lines", T.ArrayType(T.LongType()), True),
        T.StructField("text", T.StringType(), True),
    ]
)

EMBEDDING_FIELDS = (
    "chunk_id",
    "embedding",
    "embedding_model",
    "embedding_dim",
    "source_file",
    "line_start",
    "line_end",
    "ts_start",
    "ts_end",
    "severities",
)

EMBEDDING = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("embedding_model", T.StringType(), True),
        T.StructField("embedding_dim", T.IntegerType(), True),
        T.StructField("source_file", T.StringType(), True),
        T.StructField("line_start", T.LongType(), True),
        T.StructField("line_end", T.LongType(), True),
        T.StructField("ts_start", T.StringType(), True),
        T.StructField("ts_end", T.StringType(), True),
        T.StructField("severities", T.MapType(T.StringType(), T.IntegerType()), True),
    ]
)

# Index points: flat scalar metadata (sentinels instead of nulls), the citation
# as ``document``, plus the chunk text and the sources/backends arrays that the
# extra pre-filters (D-08) and evidence blocks (D-05) need.
INDEX_POINT_FIELDS = (
    "id",
    "embedding",
    "document",
    "source_file",
    "line_start",
    "line_end",
    "ts_start",
    "ts_end",
    "embedding_model",
    "embedding_dim",
    "sev_info",
    "sev_warning",
    "sev_error",
)

INDEX_EXTRA_FIELDS = ("text", "sources", "backends")

RESULT_FIELDS = (
    "chunk_id",
    "score",
    "distance",
    "document",
    "source_file",
    "line_start",
    "line_end",
    "ts_start",
    "ts_end",
    "severities",
    "rank",
)

SEVERITY_KEYS = ("info", "warning", "error")
