"""Building blocks over the given tables (``/root/testdata/sf*/``).

Logs are rendered from ``events`` (see ``sources/event_logs.py``), parsed,
chunked, hash-encoded and indexed exactly as real log files would be; the
vector-level retrieval queries use the ``embeddings`` table directly as an
index (``label`` plays the file, ``label % 3`` the error count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import citation
from ..operators.chunking import chunk_events
from ..operators.embedding import HashEncoder, embed_chunks
from ..operators.index import index_points
from ..operators.parse import classify_lines, events_of
from ..sources.event_logs import all_lines, haproxy_lines, iis_lines

CHUNK_SIZE = 20
CHUNK_OVERLAP = 4
HASH_DIM = 384


# Tables with heavy per-row work downstream (rendering and parsing log lines,
# splitting whole texts): a one-task scan of them is widened.
TEXT_TABLES = ("documents", "conversations", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return widen(df) if name in TEXT_TABLES else df


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has task slots.

    A table stored as one parquet row group is read by one task, so heavy per-row
    work after it (rendering and parsing log lines, splitting whole texts) would
    run serially until the first shuffle. Large inputs already scan into many splits and are left untouched
    (no extra shuffle at scale).
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def encoder() -> HashEncoder:
    return HashEncoder(HASH_DIM)


def haproxy_view(spark, sf_dir) -> DataFrame:
    return haproxy_lines(table(spark, sf_dir, "events"))


def iis_view(spark, sf_dir) -> DataFrame:
    return iis_lines(table(spark, sf_dir, "events"))


def all_view(spark, sf_dir) -> DataFrame:
    return all_lines(table(spark, sf_dir, "events"))


def haproxy_classified(spark, sf_dir, source_type: str = "haproxy") -> DataFrame:
    """The HAProxy files parsed with ``source_type`` configured (as the corpus
    validation job does); ``source_type='auto'`` runs detection first."""
    return classify_lines(haproxy_view(spark, sf_dir), source_type=source_type)


def haproxy_events(spark, sf_dir, policy: str = "skip", source_type: str = "haproxy") -> DataFrame:
    return events_of(haproxy_classified(spark, sf_dir, source_type), policy)


def log_chunks(spark, sf_dir) -> DataFrame:
    return chunk_events(haproxy_events(spark, sf_dir), CHUNK_SIZE, CHUNK_OVERLAP)


def chunk_records(spark, sf_dir) -> DataFrame:
    return embed_chunks(log_chunks(spark, sf_dir), encoder())


def chunk_points(spark, sf_dir) -> DataFrame:
    return index_points(chunk_records(spark, sf_dir))


def vector_points(spark, sf_dir, model: str = "table-embeddings") -> DataFrame:
    """Index rows straight from the ``embeddings`` table."""
    e = table(spark, sf_dir, "embeddings")
    sf = F.concat(F.lit("label_"), F.col("label").cast("string"))
    return e.select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding"),
        citation(sf, F.col("vec_id"), F.col("vec_id")).alias("document"),
        sf.alias("source_file"),
        F.col("vec_id").cast("long").alias("line_start"),
        F.col("vec_id").cast("long").alias("line_end"),
        F.lit("").alias("ts_start"),
        F.lit("").alias("ts_end"),
        F.lit(model).alias("embedding_model"),
        F.size("embedding").cast("int").alias("embedding_dim"),
        F.lit(1).alias("sev_info"),
        F.lit(0).alias("sev_warning"),
        (F.col("label") % 3).cast("int").alias("sev_error"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("array<string>").alias("sources"),
        F.lit(None).cast("array<string>").alias("backends"),
    )


def first_vector(spark, sf_dir) -> list[float]:
    """The query vector of the vector-level queries: the row with the smallest ``vec_id``."""
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row[0]]


# ---------------------------------------------------------------------------
# Fixed evaluation set: 12 operational questions, each with the phenomenon
# predicate (over event columns) that decides its relevance labels.
EVAL_QUERIES = (
    ("Q01", "404 not found warning errors", "status_code = 404"),
    ("Q02", "503 service unavailable error", "status_code = 503"),
    ("Q03", "301 redirect click", "status_code = 301"),
    ("Q04", "options 204 preflight no content", "method = 'OPTIONS' OR status_code = 204"),
    ("Q05", "backend down <nosrv> api", "backend LIKE '%<NOSRV>%' AND status_code >= 500"),
    ("Q06", "504 timeout gateway", "status_code = 504"),
    ("Q07", "/health check status", "path IN ('/health', '/status', '/hc')"),
    ("Q08", "5xx internal application errors error", "status_code >= 500"),
    ("Q09", "/api/purchase /api/signup api requests", "path LIKE '/api%'"),
    ("Q10", "view page traffic 200", "path LIKE '/view%'"),
    ("Q11", "401 403 unauthorized forbidden", "status_code IN (401, 403)"),
    ("Q12", "post create resources", "method = 'POST'"),
)
# Phenomenon inventory predicates (name, predicate over event columns).
PHENOMENA = (
    ("http_404", "status_code = 404"),
    ("http_503", "status_code = 503"),
    ("http_301", "status_code = 301"),
    ("method_options", "method = 'OPTIONS'"),
    ("http_204", "status_code = 204"),
    ("nosrv_5xx", "backend LIKE '%<NOSRV>%' AND status_code >= 500"),
    ("http_504", "status_code = 504"),
    ("health_paths", "path IN ('/health', '/status', '/hc')"),
    ("api_paths", "path LIKE '/api%'"),
    ("auth_401_403", "status_code IN (401, 403)"),
    ("method_post", "method = 'POST'"),
    ("server_5xx", "status_code >= 500"),
)
RETRIEVE_QUERY = "503 error be api <nosrv>"
# ---------------------------------------------------------------------------


def eval_queries(spark) -> DataFrame:
    return spark.createDataFrame([(q, t, p) for q, t, p in EVAL_QUERIES], "query_id string, query string, predicate string")


__all__ = [
    "table", "encoder", "haproxy_view", "iis_view", "all_view", "haproxy_classified", "haproxy_events",
    "log_chunks", "chunk_records", "chunk_points", "vector_points", "first_vector", "EVAL_QUERIES",
    "PHENOMENA", "RETRIEVE_QUERY", "eval_queries", "all_lines",
]
