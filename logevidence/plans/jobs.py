"""E-01..E-06: the user-level jobs.

Each stage writes its result as a table (parquet by default, JSON Lines on
request) and the next stage reads that table back: the written table is the
lineage cut, a failed executor only recomputes its partition of the current
stage, and re-reading is cheaper than re-parsing. Scratch tables go under the
cluster's ``spark.checkpoint.dir`` (see :func:`logevidence.session.shared_dir`).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Params, check_policy
from ..operators.chunking import chunk_events, stem_collisions
from ..operators.embedding import HashEncoder, embed_chunks
from ..operators.index import VectorIndex
from ..operators.parse import (STOPPED, classify_lines, error_of, events_of, first_error, line_counts, parse_stats,
                               stop_at_errors, totals_of)
from ..operators.render import render_results, render_text
from ..operators.report import corpus_report
from ..operators.retrieval import build_where, retrieve, retrieve_many
from ..schemas import CHUNK_FIELDS, EMBEDDING_FIELDS, EVENT_FIELDS
from ..session import apply_job_conf, shared_dir
from ..operators.detect import resolve_source
from ..sources.files import check_hidden_files, check_hidden_names, discover_log_files, existing_files, read_lines
from ..sources.jsonl import (STAGE_SCHEMA, STAGE_SUFFIX, load_chunks, load_embedding_records, load_events,
                             naming_bad_records, stage_input, write_json_array, write_jsonl)


@dataclass
class ParseResult:
    events_path: str
    stats: DataFrame
    totals: dict  # the total of ``stats``, counted while the lines were written


OUTPUT_FORMATS = ("parquet", "jsonl", "json")


def _check_stems(events: DataFrame) -> None:
    clash = [r["stem"] for r in stem_collisions(events).limit(5).collect()]
    if clash:
        raise ValueError(f"chunk id collision: files with the same stem {clash}; use id_scope='path'")


def _check_format(fmt: str) -> None:
    if fmt not in OUTPUT_FORMATS:
        raise ValueError(f"unknown output format {fmt!r}; use one of {list(OUTPUT_FORMATS)}")


def _write(df: DataFrame, path: str, fmt: str, fields: Sequence[str]) -> None:
    _check_format(fmt)
    if fmt != "parquet" and "source_path" in df.columns:
        _check_stems(df)  # the record layout has no path: files of one name could not be told apart later
    if fmt == "jsonl":
        write_jsonl(df, path, fields)
    elif fmt == "json":
        write_json_array(df, path, fields)
    else:
        df.write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str, fmt: str, loader, stage: str | None = None) -> DataFrame:
    """``parquet`` tables, ``jsonl`` folders written by this library, or ``stage``:
    the original ``*.events.jsonl`` / ``*.chunks.jsonl`` / ``*.embeddings.jsonl`` files (S-09)."""
    if fmt == "stage":
        return stage_input(spark, path, stage)
    return loader(spark, path) if fmt == "jsonl" else spark.read.parquet(path)


def _bad_records_named(spark: SparkSession, path: str, fmt: str, stage: str):
    """Errors of JSON input name file and line; tables have none of the kind."""
    if fmt == "parquet":
        return nullcontext()
    return naming_bad_records(spark, path, STAGE_SCHEMA[stage], f"*{STAGE_SUFFIX[stage]}" if fmt == "stage" else "*")


def classify_files(spark: SparkSession, logs_path: str, params: Params = Params(), *,
                   forced_source: str | None = None) -> DataFrame:
    """E-01 front half on real files, one route for any number and names of files.

    The folder is read by its patterns; no file list goes through the driver.
    With one kind the lines go straight to its parser. Otherwise the numbered
    lines are written once, so the text files are scanned for that only, and
    the kinds (P-16) and both parsers read that table.
    """
    fixed = resolve_source(forced_source, params.source_type)
    opts = dict(iis_fields=params.iis_fields, iis_fields_from_header=params.iis_fields_from_header)
    patterns = params.effective_patterns()
    if discover_log_files(spark, logs_path, patterns, recursive=params.recursive).isEmpty():
        raise FileNotFoundError(f"no log files matching {patterns} under {logs_path}")
    lines = read_lines(spark, logs_path, patterns=patterns, recursive=params.recursive, encoding=params.encoding)
    if fixed is None:
        path = shared_dir(spark, "numbered-lines")
        lines.write.parquet(path)
        lines = spark.read.schema(lines.schema).parquet(path)
    return classify_lines(lines, forced_source=fixed, **opts)


def parse_logs(spark: SparkSession, logs_path: str, out_path: str, params: Params = Params(), *,
               forced_source: str | None = None, output_format: str = "parquet") -> ParseResult:
    """E-01: log files -> events table (+ per-file and total statistics).

    The classified lines are written once; events and statistics are both
    derived from that table, so the text is parsed exactly once. Totals are
    counted on the writing pass. Under ``fail`` that write stops at the first task
    with an unparseable line, and the first such line of all is then looked up.
    """
    apply_job_conf(spark)
    params.check()
    check_policy(params.on_parse_error)
    _check_format(output_format)
    cl = classify_files(spark, logs_path, params, forced_source=forced_source)
    bronze = shared_dir(spark, "classified-lines")
    counted = Observation("lines")
    to_write = stop_at_errors(cl) if params.on_parse_error == "fail" else cl
    try:
        to_write.observe(counted, *line_counts()).write.mode("overwrite").parquet(bronze)
    except Exception as exc:
        if STOPPED not in str(exc):
            raise
        raise error_of(first_error(cl)) from exc
    cl = spark.read.schema(cl.schema).parquet(bronze)
    ev = events_of(cl, "keep" if params.on_parse_error == "keep" else "skip")
    _write(ev, out_path, output_format, EVENT_FIELDS)
    return ParseResult(out_path, parse_stats(cl, params.on_parse_error), totals_of(counted.get, params.on_parse_error))


def chunk_logs(spark: SparkSession, events_path: str, out_path: str, params: Params = Params(), *,
               input_format: str = "parquet", output_format: str = "parquet", id_scope: str = "stem") -> DataFrame:
    """E-02: events table -> chunks table. An empty events table gives 0 chunks.

    With stem ids, two files sharing a name in different folders would collide:
    that is reported as an error (use ``id_scope='path'``).
    """
    apply_job_conf(spark)
    params.check()
    ev = _read(spark, events_path, input_format, load_events, "events")
    if not ev.inputFiles():
        raise FileNotFoundError(f"no events under {events_path}")
    with _bad_records_named(spark, events_path, input_format, "events"):
        if input_format == "stage":  # one events file per original log: its stem names the chunks
            ch = chunk_events(ev, params.chunk_size, params.chunk_overlap, key="stage_file",
                              stem=F.regexp_replace(F.regexp_extract("stage_file", "([^/]*)$", 1), "[.]events[.]jsonl$", ""))
        else:
            if id_scope == "stem" and "source_path" in ev.columns:
                _check_stems(ev)
            ch = chunk_events(ev, params.chunk_size, params.chunk_overlap, id_scope=id_scope)
        _write(ch, out_path, output_format, CHUNK_FIELDS)
    return _read(spark, out_path, output_format, load_chunks)


def embed_chunks_job(spark: SparkSession, chunks_path: str, out_path: str, encoder=None, *,
                     input_format: str = "parquet", output_format: str = "parquet",
                     params: Params = Params()) -> DataFrame:
    """E-03: chunks table -> embedding records (model loaded once per worker)."""
    apply_job_conf(spark)
    encoder = encoder or HashEncoder(params.embedding_dim)
    ch = _read(spark, chunks_path, input_format, load_chunks, "chunks")
    if not ch.inputFiles():
        raise FileNotFoundError(f"no chunks under {chunks_path}")
    rec = embed_chunks(ch, encoder)
    with _bad_records_named(spark, chunks_path, input_format, "chunks"):
        _write(rec, out_path, output_format, EMBEDDING_FIELDS)
    return _read(spark, out_path, output_format, load_embedding_records)


def index_embeddings(spark: SparkSession, records_path: str, index_root: str, params: Params = Params(), *,
                     input_format: str = "parquet") -> VectorIndex:
    """E-04: embedding records -> versioned parquet index (idempotent upsert by id)."""
    apply_job_conf(spark)
    rec = _read(spark, records_path, input_format, load_embedding_records, "embeddings")
    ix = VectorIndex(spark, index_root, params.collection_name, params.similarity_metric).open()
    with _bad_records_named(spark, records_path, input_format, "embeddings"):
        ix.upsert(rec)
    return ix


def retrieve_job(spark: SparkSession, index_root: str, query: str, encoder=None, params: Params = Params(), *,
                 source: str | None = None, severity: str | None = None, as_text: bool = False):
    """E-05: one text query -> ranked, cited results (DataFrame, or the rendered report)."""
    apply_job_conf(spark)
    params.check()
    ix = VectorIndex(spark, index_root, params.collection_name, params.similarity_metric).open()
    res = retrieve(spark, ix.points(), query, encoder or HashEncoder(params.embedding_dim), top_k=params.top_k,
                   where=build_where(source, severity), metric=params.similarity_metric,
                   score_threshold=params.score_threshold)
    return render_text(query, res) if as_text else render_results(res)


def retrieve_batch_job(spark: SparkSession, index_root: str, queries: DataFrame, encoder=None,
                       params: Params = Params()) -> DataFrame:
    """E-05 batched: ``queries(query_id, query)`` in one pass over the index."""
    apply_job_conf(spark)
    ix = VectorIndex(spark, index_root, params.collection_name, params.similarity_metric).open()
    return retrieve_many(spark, ix.points(), queries, encoder or HashEncoder(params.embedding_dim), top_k=params.top_k,
                         metric=params.similarity_metric, score_threshold=params.score_threshold)


def validate_corpus(spark: SparkSession, files: Sequence[str] | str, index_root: str, params: Params = Params(), *,
                    source: str = "haproxy", encoder=None, id_scope: str = "stem") -> dict:
    """E-06: every stage end to end into the separate ``<collection>_validacion``
    collection, with per-file counts, totals and wall-clock seconds per stage."""
    apply_job_conf(spark)
    params.check()
    encoder = encoder or HashEncoder(params.embedding_dim)
    skipped: list[str] = []
    if not isinstance(files, str):
        files, skipped = existing_files(spark, list(files))
        check_hidden_names(files)
    else:
        check_hidden_files(spark, files, params.effective_patterns(), params.recursive)
    secs = {}
    t0 = time.perf_counter()
    lines = read_lines(spark, files, patterns=params.effective_patterns(), recursive=params.recursive,
                       encoding=params.encoding)
    cl = classify_lines(lines, forced_source=source, iis_fields=params.iis_fields,
                        iis_fields_from_header=params.iis_fields_from_header)
    p_cl = shared_dir(spark, "validate-classified")
    cl.write.mode("overwrite").parquet(p_cl)
    cl = spark.read.schema(cl.schema).parquet(p_cl)
    ev = events_of(cl, "keep" if params.on_parse_error == "keep" else "skip")
    secs["t_parse"] = time.perf_counter() - t0
    t0 = time.perf_counter()
    if id_scope == "stem":
        _check_stems(ev)
    p_ch = shared_dir(spark, "validate-chunks")
    chunks = chunk_events(ev, params.chunk_size, params.chunk_overlap, id_scope=id_scope)
    chunks.write.mode("overwrite").parquet(p_ch)
    ch = spark.read.schema(chunks.schema).parquet(p_ch)
    secs["t_chunk"] = time.perf_counter() - t0
    t0 = time.perf_counter()
    p_rec = shared_dir(spark, "validate-embeddings")
    records = embed_chunks(ch, encoder)
    records.write.mode("overwrite").parquet(p_rec)
    rec = spark.read.schema(records.schema).parquet(p_rec)
    secs["t_embed"] = time.perf_counter() - t0
    t0 = time.perf_counter()
    ix = VectorIndex(spark, index_root, f"{params.collection_name}_validacion", params.similarity_metric).open()
    ix.upsert(rec)
    secs["t_index"] = time.perf_counter() - t0
    report = corpus_report(cl, rec, params.on_parse_error)
    return {
        "source": source,
        "collection": f"{params.collection_name}_validacion",
        "embedding_model": encoder.name,
        "chunk_size": params.chunk_size,
        "chunk_overlap": params.chunk_overlap,
        "skipped_files": skipped,
        "indexed_count": ix.count(),
        "seconds": {k: round(v, 3) for k, v in secs.items()},
        "report": report,
    }


def write_report(report: DataFrame, path: str) -> None:
    """K-06: the corpus report as JSON (one small file: one row per input file + total)."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


__all__ = ["parse_logs", "chunk_logs", "embed_chunks_job", "index_embeddings", "retrieve_job", "retrieve_batch_job",
           "validate_corpus", "write_report", "ParseResult"]
