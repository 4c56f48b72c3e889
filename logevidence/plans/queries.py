"""Registered queries over the given tables: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query runs over whole tables. Output columns are scalars (maps and
arrays flattened or joined) and every float is rounded, so results compare
exactly with the SQL oracles in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import severities_text
from ..functions.text import split_lines
from ..functions.vectors import TOKEN_SPLIT
from ..operators.detect import detect_sources
from ..operators.iis import active_headers
from ..operators.parse import classify_lines, events_of, parse_stats
from ..operators.retrieval import attach_text, build_where, extra_where, retrieve, retrieve_many, search, shape_results
from ..config import ABSTENTION_SENTENCE, Params
from ..operators.chunking import chunk_events, positioned_events
from ..operators.citations import answer_metrics, evidence_blocks, evidence_text, expand_markers, validate_answers
from ..operators.embedding import BatchEncoder, HashEncoder, embed_chunks
from ..operators.evaluation import chunk_histograms, chunk_membership, phenomenon_counts, precision_at_k, relevance_labels
from ..operators.index import VectorIndex, dedup_last, upsert_frames
from ..operators.render import render_results
from ..operators.report import corpus_report
from ..session import shared_dir
from ..sources.files import discover_log_files, read_lines
from ..schemas import EVENT, EVENT_FIELDS
from ..sources.jsonl import STAGE_SUFFIX, bad_records, load_events, write_chunks, write_events, write_json_array
from . import driver_tables as D
from .jobs import chunk_logs, embed_chunks_job, index_embeddings, parse_logs, retrieve_job, validate_corpus, write_report

EVENT_OUT = ("timestamp", "source", "severity", "client_ip", "method", "path", "status_code", "bytes",
             "duration_ms", "backend", "source_file", "line_number", "raw")
RESULT_OUT = ("chunk_id", "score", "distance", "document", "source_file", "line_start", "line_end",
              "ts_start", "ts_end", "sev_info", "sev_warning", "sev_error", "rank")


def q_parse_haproxy(spark: SparkSession, sf: str) -> DataFrame:
    """P-01..P-04, P-10, P-12, P-14 (with P-16 detection): HAProxy lines -> 13-column events."""
    return D.haproxy_events(spark, sf, source_type="auto").select(*EVENT_OUT)


def q_parse_iis(spark: SparkSession, sf: str) -> DataFrame:
    """P-05..P-09, P-11: IIS lines -> events (header-defined columns)."""
    return events_of(classify_lines(D.iis_view(spark, sf))).select(*EVENT_OUT)


def q_iis_header_asof(spark: SparkSession, sf: str) -> DataFrame:
    """J-01: the ``#Fields:`` line in force for every IIS data line."""
    h = active_headers(D.iis_view(spark, sf))
    data = h.where(~F.col("raw").startswith("#") & (F.col("raw") != ""))
    return data.select("source_file", "line_number", "header_line", F.size("header_fields").alias("n_fields"))


def q_detect_source(spark: SparkSession, sf: str) -> DataFrame:
    """P-16/P-17: parser chosen for every file."""
    return detect_sources(D.all_view(spark, sf)).select("source_file", "source")


def q_severity_hist(spark: SparkSession, sf: str) -> DataFrame:
    """P-13: events per source and severity over both log kinds."""
    ev = events_of(classify_lines(D.all_view(spark, sf)))
    return ev.groupBy("source", "severity").agg(F.count(F.lit(1)).alias("n_events"))


def q_parse_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A-01/A-02, F-01: per-file and total parse statistics (policy skip)."""
    st = parse_stats(classify_lines(D.all_view(spark, sf)), "skip")
    return st.select("source_file", "source", "files", "lines", "ok", "skipped_errors", "kept_errors", "events",
                     "is_total")


def q_on_error_keep(spark: SparkSession, sf: str) -> DataFrame:
    """F-02/P-15: policy keep inserts placeholder events for unparseable lines."""
    return D.haproxy_events(spark, sf, "keep").select(*EVENT_OUT)


def _chunk_scalars(ch: DataFrame) -> DataFrame:
    sev = lambda k: F.coalesce(F.try_element_at("severities", F.lit(k)), F.lit(0)).alias(f"sev_{k}")
    return ch.select(
        "chunk_id", "source_file", "line_start", "line_end", "ts_start", "ts_end", "n_events",
        sev("info"), sev("warning"), sev("error"),
        F.array_join("sources", ",").alias("sources"),
        F.array_join(F.transform("event_lines", lambda x: x.cast("string")), ",").alias("event_lines"),
        severities_text("severities").alias("severities_text"),
    )


def q_chunk_events(spark: SparkSession, sf: str) -> DataFrame:
    """W-01..W-03, A-03..A-11, F-09: overlapping count windows per file."""
    return _chunk_scalars(D.log_chunks(spark, sf))


def q_chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """P-18, A-09: rendered chunk text."""
    return D.log_chunks(spark, sf).select("chunk_id", "text")


def q_embed(spark: SparkSession, sf: str) -> DataFrame:
    """X-01, X-02, P-22, J-02: hash-encoded chunk vectors (summarised per chunk).

    ``bucket_sig`` = sum of (index + 1) over the non-zero components, so the
    occupied buckets are checked exactly; ``max_weight`` checks the normalisation.
    """
    rec = D.chunk_records(spark, sf)
    toks = F.filter(F.split(F.lower(F.col("text")), TOKEN_SPLIT, -1), lambda t: t != "")
    idx = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i + 1).otherwise(0)), lambda i: i > 0)
    return rec.select(
        "chunk_id", "embedding_model", "embedding_dim",
        F.size(toks).alias("n_tokens"),
        F.aggregate(idx, F.lit(0).cast("long"), lambda a, x: a + x).alias("bucket_sig"),
        F.size(idx).alias("n_buckets"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("max_weight"),
    )


def _results(df: DataFrame) -> DataFrame:
    return df.select(*RESULT_OUT)


def _vector_topk(spark, sf, metric, top_k=10, where=None, threshold=0.0):
    pts = D.vector_points(spark, sf)
    return _results(shape_results(search(pts, D.first_vector(spark, sf), top_k, metric, where), metric, threshold))


def q_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """T-01, T-02, P-23..P-25: exact top-10 by cosine distance."""
    return _vector_topk(spark, sf, "cosine")


def q_topk_l2(spark: SparkSession, sf: str) -> DataFrame:
    """T-01 with squared-L2 distance, score 1/(1+d)."""
    return _vector_topk(spark, sf, "l2")


def q_topk_ip(spark: SparkSession, sf: str) -> DataFrame:
    """T-01 with inner-product distance 1-dot, score 1/(1+d)."""
    return _vector_topk(spark, sf, "ip")


def q_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """F-03..F-06: file and severity filters applied before top-k."""
    return _vector_topk(spark, sf, "cosine", where=build_where(source="label_1", severity="error"))


def q_topk_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """F-07, W-04: score threshold after top-k, ranks after the threshold."""
    return _vector_topk(spark, sf, "cosine", top_k=20, threshold=0.25)


def q_retrieve_text(spark: SparkSession, sf: str) -> DataFrame:
    """T-03/E-05: text query -> hash vector -> top-5 cited chunks."""
    res = retrieve(spark, D.chunk_points(spark, sf), D.RETRIEVE_QUERY, D.encoder(), top_k=5)
    return _results(res)


def q_topk_time_filter(spark: SparkSession, sf: str) -> DataFrame:
    """D-08: time-range, source-type and backend pre-filters."""
    where = extra_where(ts_from="2024-01-05T00:00:00+00:00", ts_to="2024-01-20T23:59:59+00:00",
                        source_types=["haproxy"], backends=["be_api/<NOSRV>"])
    res = retrieve(spark, D.chunk_points(spark, sf), D.RETRIEVE_QUERY, D.encoder(), top_k=5, where=where)
    return _results(res)


def _batch_results(spark, sf, top_k=3) -> DataFrame:
    return retrieve_many(spark, D.chunk_points(spark, sf), D.eval_queries(spark), D.encoder(), top_k=top_k)


def q_batch_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """T-04/J-04: 12 queries x top-3 in one pass over the index."""
    return _batch_results(spark, sf).select("query_id", *RESULT_OUT)


def q_citation(spark: SparkSession, sf: str) -> DataFrame:
    """P-20/P-19/P-21: citation document and flat metadata of every index point."""
    return D.chunk_points(spark, sf).select(
        "id", "document", "source_file", "line_start", "line_end", "ts_start", "ts_end", "embedding_dim",
        "sev_info", "sev_warning", "sev_error")


def q_split_lines(spark: SparkSession, sf: str) -> DataFrame:
    """S-03/S-04 (exact mode): documents split on every line boundary, numbered from 1."""
    docs = D.table(spark, sf, "documents").where(F.col("text").isNotNull())
    ex = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    return ex.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_number"),
                     F.length("line").alias("n_chars"), F.md5(F.col("line")).alias("line_md5"))


def q_index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K-05/J-03/P-21: upsert by id (left anti + union). The second load re-indexes the
    whole table under a new model with ids shifted by 250, so half overlaps."""
    cur = D.vector_points(spark, sf, model="v1")
    new = D.vector_points(spark, sf, model="v2").withColumn(
        "id", (F.col("id").cast("long") + 250).cast("string"))
    merged = upsert_frames(cur, dedup_last(new))
    return merged.select("id", "embedding_model", "document", "source_file", "sev_error")


def q_index_count(spark: SparkSession, sf: str) -> DataFrame:
    """S-10: points after the upsert of ``q_index_upsert``, in total and per model."""
    up = q_index_upsert(spark, sf)
    return up.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("n_points"))


def q_render_results(spark: SparkSession, sf: str) -> DataFrame:
    """P-26: human-readable result lines of the text retrieval."""
    res = retrieve(spark, D.chunk_points(spark, sf), D.RETRIEVE_QUERY, D.encoder(), top_k=5)
    return render_results(res).select("rank", "rendered")


def q_corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    """A-12/E-06/U-02: lines, events, chunks and embeddings per file and in total."""
    cl = classify_lines(D.all_view(spark, sf))
    ev = events_of(cl)
    ch = chunk_events(ev, D.CHUNK_SIZE, D.CHUNK_OVERLAP)
    rec = embed_chunks(ch, D.encoder())
    rep = corpus_report(cl, rec)
    return rep.select("source_file", "files", "lines", "events", "chunks", "embeddings", "is_total")


def q_jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K-01/S-06: events written as JSON Lines (null keys kept) and read back with the closed schema."""
    path = shared_dir(spark, "events-jsonl")
    write_events(D.haproxy_events(spark, sf), path)
    return load_events(spark, path).select(*EVENT_OUT)


def _written_logs(spark, sf) -> str:
    """Render the HAProxy view as real text files under ``app=<name>/``. Rows are
    range-partitioned on (app, line) so a large app becomes several part files,
    each a contiguous run of its lines (no task holds a whole app)."""
    path = shared_dir(spark, "logs")
    v = D.haproxy_view(spark, sf).withColumn("app", F.regexp_replace("source_file", "[.]log$", ""))
    (v.repartitionByRange("app", "line_number").sortWithinPartitions("app", "line_number").select("app", "raw")
     .write.mode("overwrite").partitionBy("app").text(path))
    return path


def q_read_files(spark: SparkSession, sf: str) -> DataFrame:
    """S-01/S-03/S-04/E-01 on real files: per app folder lines, parse results, characters,
    and whether every part file is numbered exactly 1..n."""
    path = _written_logs(spark, sf)
    lines = read_lines(spark, path, patterns=("*.txt",), recursive=True)
    cl = classify_lines(lines, forced_source="haproxy")
    per_file = cl.groupBy(F.regexp_extract("source_path", "app=([^/]+)/", 1).alias("app"), "source_path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
        F.sum(F.length("raw")).alias("chars"),
        ((F.min("line_number") == 1) & (F.max("line_number") == F.count(F.lit(1)))
         & (F.count_distinct("line_number") == F.count(F.lit(1)))).alias("numbered"),
    )
    return per_file.groupBy("app").agg(
        *[F.sum(c).alias(c) for c in ("lines", "ok", "errors", "skipped", "chars")],
        F.bool_and("numbered").alias("numbered_1_to_n"),
    )


def q_line_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """S-03 in the default mode: documents with other line boundaries in place of sentence ends, written as
    text files and read as lines, counted by length."""
    path = shared_dir(spark, "boundaries")
    docs = D.table(spark, sf, "documents").where(F.col("text").isNotNull())
    mark = F.element_at(F.array(F.lit("\x0b"), F.lit("\u2028"), F.lit("\r"), F.lit("\x85\x1c")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    docs.select(F.replace("text", F.lit(". "), mark).alias("value")).write.text(path)
    lines = read_lines(spark, path, patterns=("*.txt",))
    return lines.groupBy(F.length("raw").alias("n_chars")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.min(F.md5("raw")).alias("first_md5"), F.max(F.md5("raw")).alias("last_md5"))


def q_discover(spark: SparkSession, sf: str) -> DataFrame:
    """S-01/S-02/U-01/T-05: recursive multi-pattern discovery over written log files,
    summarised per app folder (file count is split-dependent; the byte total is not)."""
    path = _written_logs(spark, sf)
    files = discover_log_files(spark, path, ("*.txt", "*.gz"), recursive=True)
    return files.groupBy(F.regexp_extract("path", "app=([^/]+)/", 1).alias("app")).agg(
        F.sum("length").alias("total_bytes"))


def _members(spark, sf):
    return chunk_membership(D.haproxy_events(spark, sf), D.CHUNK_SIZE, D.CHUNK_OVERLAP)


def q_chunk_status_hist(spark: SparkSession, sf: str) -> DataFrame:
    """D-01: status and method histogram of every chunk."""
    return chunk_histograms(_members(spark, sf))


def _labels(spark, sf):
    res = _batch_results(spark, sf)
    preds = [(q, p) for q, _, p in D.EVAL_QUERIES]
    return relevance_labels(res, _members(spark, sf), preds)


def q_relevance_labels(spark: SparkSession, sf: str) -> DataFrame:
    """D-02: R/P/N label of every retrieved chunk from its real events."""
    return _labels(spark, sf)


def q_precision_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """D-03: precision@1 (strict, R-or-P, weighted), precision@3 weighted, success@3."""
    asked = spark.createDataFrame([(q,) for q, _, _ in D.EVAL_QUERIES], "query_id string")
    return precision_at_k(_labels(spark, sf), 3, asked)


def q_precision_misses(spark: SparkSession, sf: str) -> DataFrame:
    """D-03 where half of the queries have no result: they count as misses."""
    ids = sorted(q for q, _, _ in D.EVAL_QUERIES)
    asked = spark.createDataFrame([(q,) for q in ids], "query_id string")
    return precision_at_k(_labels(spark, sf).where(F.col("query_id").isin(ids[: len(ids) // 2])), 3, asked)


def q_phenomena(spark: SparkSession, sf: str) -> DataFrame:
    """D-04: phenomenon inventory over all parsed events."""
    ev = events_of(classify_lines(D.all_view(spark, sf)))
    return phenomenon_counts(ev, D.PHENOMENA)


def _text_results(spark, sf):
    return retrieve(spark, D.chunk_points(spark, sf), D.RETRIEVE_QUERY, D.encoder(), top_k=5)


def q_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """D-05: evidence blocks E1..Ek with header and chunk text."""
    pts = D.chunk_points(spark, sf)
    res = retrieve(spark, pts, D.RETRIEVE_QUERY, D.encoder(), top_k=5)
    return evidence_blocks(attach_text(pts, res)).select("evidence_id", "chunk_id", "header", "text")


def _answers(spark, sf) -> DataFrame:
    """Assistant turns of ``conversations`` as answers with a deterministic [E#] marker appended
    (every tenth conversation answers with the abstention sentence)."""
    c = D.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    mark = F.concat(F.lit(" [E"), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("string"), F.lit("]"))
    ans = F.when(F.col("conv_id") % 10 == 0, F.lit(ABSTENTION_SENTENCE)).otherwise(
        F.concat(F.coalesce(F.col("text"), F.lit("")), mark))
    return c.select("conv_id", "turn", ans.alias("answer"))


def q_parse_files(spark: SparkSession, sf: str) -> DataFrame:
    """E-01/S-01/S-03/P-16 as a user calls it: log files under folders whose names hold spaces,
    hashes and brackets, through the parse job with detection, events read back as JSON Lines."""
    path = shared_dir(spark, "odd-logs")
    v = D.haproxy_view(spark, sf).withColumn("app", F.concat(F.regexp_replace("source_file", "[.]log$", ""), F.lit(" #1 [a] %2")))
    (v.repartitionByRange("app", "line_number").sortWithinPartitions("app", "line_number").select("app", "raw")
     .write.partitionBy("app").text(path))
    out = shared_dir(spark, "odd-events")
    parse_logs(spark, path, out, Params(recursive=True, file_patterns=("*.txt",)))
    return load_parquet_events(spark, out)


def load_parquet_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the parse job, counted per original app and severity."""
    ev = spark.read.parquet(path)
    app = F.regexp_extract(F.url_decode(F.replace("source_path", F.lit("+"), F.lit("%2B"))), "app=([^ /]+) #1 ", 1)
    return ev.groupBy(app.alias("app"), "severity").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("bytes").alias("bytes"), F.sum("duration_ms").alias("duration_ms"),
        F.sum(F.length("raw")).alias("chars"))


def q_jobs_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """S-06..S-08/K-01/K-03/K-04/E-02/E-03: events, chunks and embedding records through the jobs as JSON Lines."""
    events, chunks, records = (shared_dir(spark, f"stage-{x}") for x in ("events", "chunks", "records"))
    write_events(D.haproxy_events(spark, sf), events)
    params = Params(chunk_size=D.CHUNK_SIZE, chunk_overlap=D.CHUNK_OVERLAP, embedding_dim=D.HASH_DIM)
    chunk_logs(spark, events, chunks, params, input_format="jsonl", output_format="jsonl")
    rec = embed_chunks_job(spark, chunks, records, input_format="jsonl", output_format="jsonl", params=params)
    return rec.select("chunk_id", "source_file", "line_start", "line_end", "ts_start", "ts_end")


def q_validate_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """E-06/S-05/K-06/A-12: the corpus job over an explicit list of log files with a missing one; its report, written
    and read as JSON, as sums that no split of the files changes, and whether the stages' counts agree."""
    path = _written_logs(spark, sf)
    # Parts of one write: at most apps x shuffle partitions.
    files = [r["path"] for r in discover_log_files(spark, path, ("*.txt",), recursive=True).collect()]
    params = Params(chunk_size=D.CHUNK_SIZE, chunk_overlap=D.CHUNK_OVERLAP, embedding_dim=D.HASH_DIM)
    done = validate_corpus(spark, [*files, f"{path}/gone.txt"], shared_dir(spark, "index"), params, id_scope="path")
    out = shared_dir(spark, "report")
    write_report(done["report"], out)
    n, step = F.col("events"), D.CHUNK_SIZE - D.CHUNK_OVERLAP
    windows = F.when(n == 0, 0).when(n <= D.CHUNK_SIZE, 1).otherwise(1 + F.ceil((n - D.CHUNK_SIZE) / step))
    return spark.read.schema(done["report"].schema).json(out).groupBy("is_total").agg(
        F.sum("lines").alias("lines"), F.sum("events").alias("events"),
        F.bool_and(F.col("is_total") | (F.col("chunks") == windows)).alias("all_windows"),
        F.bool_and(F.col("chunks") == F.col("embeddings")).alias("all_embedded"),
        (F.sum("chunks") == F.lit(done["indexed_count"])).alias("all_indexed"),
        F.lit(len(done["skipped_files"])).alias("skipped_files"),
        F.lit(done["collection"]).alias("collection"),
    )


def _as_stage_files(spark: SparkSession, path: str, stage: str) -> str:
    """Give the part files of a ``file=<stem>`` folder the names of a stage's interchange files."""
    sc = spark.sparkContext
    for i, r in enumerate(discover_log_files(spark, path, ("*.json",), recursive=True).collect()):
        old = sc._jvm.org.apache.hadoop.fs.Path(r["path"])
        old.getFileSystem(sc._jsc.hadoopConfiguration()).rename(old, sc._jvm.org.apache.hadoop.fs.Path(old.getParent(), f"p{i}{STAGE_SUFFIX[stage]}"))
    return path


def q_stage_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """S-09/X-02/E-03..E-05/P-26: chunk files named by stage through a batch encoder, the index job and the retrieval job."""
    events, chunks, records, root = (shared_dir(spark, f"stage-{x}") for x in ("events", "chunks", "records", "index"))
    params = Params(embedding_dim=D.HASH_DIM, top_k=5)
    encoder = BatchEncoder(lambda: HashEncoder(D.HASH_DIM).encode_local, "batched-hash")
    # Numbering the events and cutting them into chunks both read them: written first, lines are parsed once.
    parsed = D.haproxy_events(spark, sf)
    parsed.write.parquet(events)
    write_chunks(chunk_events(spark.read.schema(parsed.schema).parquet(events), D.CHUNK_SIZE, D.CHUNK_OVERLAP), chunks)
    embed_chunks_job(spark, _as_stage_files(spark, chunks, "chunks"), records, encoder, input_format="stage",
                     output_format="jsonl", params=params)
    index_embeddings(spark, _as_stage_files(spark, records, "embeddings"), root, params, input_format="stage")
    return retrieve_job(spark, root, D.RETRIEVE_QUERY, encoder, params).select("rank", "rendered")


def q_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """K-02: events as one JSON array per file, in lines of one record each, read back; the arrays' ends by file."""
    path = shared_dir(spark, "arrays")
    write_json_array(D.haproxy_events(spark, sf), path)
    lines = spark.read.text(path).withColumn("record", F.from_json(F.expr("substr(ltrim('[', value), 1, length(ltrim('[', value)) - 1)"), EVENT))
    return lines.groupBy("record.source_file").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("record.bytes").alias("bytes"),
        F.sum(F.length("record.raw")).alias("chars"),
        F.min(F.when(F.col("value").startswith("["), F.col("record.line_number"))).alias("first_line"),
        F.count_if(F.col("value").startswith("[")).alias("n_open"),
        F.max(F.when(F.col("value").endswith("]"), F.col("record.line_number"))).alias("last_line"),
        F.count_if(F.col("value").endswith("]")).alias("n_close"))


def q_bad_records(spark: SparkSession, sf: str) -> DataFrame:
    """S-06/F-10: JSON Lines files of events with unparseable and blank lines among them: the lines that are no records."""
    path = shared_dir(spark, "mixed-jsonl")
    cl = D.haproxy_classified(spark, sf).withColumn("app", F.regexp_replace("source_file", "[.]log$", ""))
    record = F.to_json(F.struct(*EVENT_FIELDS), {"ignoreNullFields": "false"})
    value = F.when(F.col("status") == "ok", record).otherwise(F.col("raw"))
    cl.select("app", value.alias("value")).write.partitionBy("app").text(path)
    bad = bad_records(spark, path, EVENT)
    return bad.select(F.regexp_extract("source_path", "app=([^/]+)/", 1).alias("app"), "raw", (F.col("line_number") > 0).alias("numbered"))


def q_index_disk(spark: SparkSession, sf: str) -> DataFrame:
    """K-05/S-10/S-11/X-04 on the stored index: a load, a second one with overlapping and repeated ids
    (the later of each counts), every point with its vector, and the count."""
    ix = VectorIndex(spark, shared_dir(spark, "index"), "disk").open()
    ix.upsert(D.vector_points(spark, sf, model="m"))
    shifted = D.vector_points(spark, sf, model="m").withColumn("id", (F.col("id").cast("long") + 250).cast("string"))
    first = shifted.withColumn("document", F.lit("first")).withColumn("seq", F.lit(1))
    ix.upsert(first.unionByName(shifted.withColumn("document", F.lit("second")).withColumn("seq", F.lit(2))), order_col="seq")
    return ix.points().select(
        "id", F.when(F.col("document") == "second", "second").otherwise("loaded").alias("state"), "source_file",
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("vector_sum"),
        F.lit(ix.count()).alias("n_points"))


def q_chunk_null_lines(spark: SparkSession, sf: str) -> DataFrame:
    """F-09/W-02: events whose line number is missing stay in their file's chunks."""
    ev = D.haproxy_events(spark, sf).withColumn("line_number", F.when(F.col("line_number") % 10 != 0, F.col("line_number")))
    pos = positioned_events(ev, "source_file")
    return pos.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_events"), F.count("line_number").alias("n_numbered"),
        F.count_distinct("pos").alias("n_positions"), F.max("pos").cast("long").alias("last"))


def q_expand_citations(spark: SparkSession, sf: str) -> DataFrame:
    """D-06: every [E#] marker expanded to file:Lx-Ly, time range and severities."""
    return expand_markers(_answers(spark, sf), _text_results(spark, sf))


def q_validate_citations(spark: SparkSession, sf: str) -> DataFrame:
    """D-07: per answer marker validity, abstention, uncited sentences and pass flag."""
    return validate_answers(_answers(spark, sf), _text_results(spark, sf).count())


def q_answer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """D-07 over all answers: marker validity, grounding and unverified share."""
    return answer_metrics(q_validate_citations(spark, sf))


def q_evidence_text(spark: SparkSession, sf: str) -> DataFrame:
    """D-05: the evidence of one query as one text."""
    pts = D.chunk_points(spark, sf)
    return evidence_text(attach_text(pts, retrieve(spark, pts, D.RETRIEVE_QUERY, D.encoder(), top_k=5)))


REGISTRY = {
    "q_parse_haproxy": q_parse_haproxy,
    "q_parse_iis": q_parse_iis,
    "q_iis_header_asof": q_iis_header_asof,
    "q_detect_source": q_detect_source,
    "q_severity_hist": q_severity_hist,
    "q_parse_stats": q_parse_stats,
    "q_on_error_keep": q_on_error_keep,
    "q_chunk_events": q_chunk_events,
    "q_chunk_text": q_chunk_text,
    "q_embed": q_embed,
    "q_topk_cosine": q_topk_cosine,
    "q_topk_l2": q_topk_l2,
    "q_topk_ip": q_topk_ip,
    "q_topk_filtered": q_topk_filtered,
    "q_topk_threshold": q_topk_threshold,
    "q_retrieve_text": q_retrieve_text,
    "q_topk_time_filter": q_topk_time_filter,
    "q_batch_retrieve": q_batch_retrieve,
    "q_citation": q_citation,
    "q_split_lines": q_split_lines,
    "q_index_upsert": q_index_upsert,
    "q_index_count": q_index_count,
    "q_render_results": q_render_results,
    "q_corpus_report": q_corpus_report,
    "q_jsonl_roundtrip": q_jsonl_roundtrip,
    "q_read_files": q_read_files,
    "q_line_boundaries": q_line_boundaries,
    "q_discover": q_discover,
    "q_chunk_status_hist": q_chunk_status_hist,
    "q_relevance_labels": q_relevance_labels,
    "q_precision_at_k": q_precision_at_k,
    "q_phenomena": q_phenomena,
    "q_evidence": q_evidence,
    "q_expand_citations": q_expand_citations,
    "q_validate_citations": q_validate_citations,
    "q_answer_metrics": q_answer_metrics,
    "q_evidence_text": q_evidence_text,
    "q_chunk_null_lines": q_chunk_null_lines,
    "q_index_disk": q_index_disk,
    "q_jobs_jsonl": q_jobs_jsonl,
    "q_parse_files": q_parse_files,
    "q_precision_misses": q_precision_misses,
    "q_validate_corpus": q_validate_corpus,
    "q_stage_jobs": q_stage_jobs,
    "q_json_array": q_json_array,
    "q_bad_records": q_bad_records,
}
