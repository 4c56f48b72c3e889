import os

import pytest
from test_haproxy_parser import L1, L2, L3, L4

from logevidence.config import Params
from logevidence.plans.jobs import (chunk_logs, embed_chunks_job, index_embeddings, parse_logs, retrieve_job,
                                    validate_corpus)
from logevidence.streaming.ingest import start_ingest


def write(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("\n".join(rows) + "\n")


def test_jobs_end_to_end(spark, tmpdir_path):
    logs = f"{tmpdir_path}/logs"
    write(f"{logs}/haproxy_a.log", [L1, L2, L3, L4, ""] * 10)
    write(f"{logs}/iis_b.log", ["#Fields: date time sc-status cs-uri-stem", "2026-03-03 09:00:01 503 /x"] * 3)
    res = parse_logs(spark, logs, f"{tmpdir_path}/events")
    st = {r["source_file"]: r for r in res.stats.collect()}
    assert st["haproxy_a.log"]["ok"] == 30 and st["haproxy_a.log"]["skipped_errors"] == 10
    assert st["iis_b.log"]["ok"] == 3 and st[None]["files"] == 2
    ch = chunk_logs(spark, f"{tmpdir_path}/events", f"{tmpdir_path}/chunks", Params(chunk_size=10, chunk_overlap=2))
    assert ch.count() == 4 + 1
    embed_chunks_job(spark, f"{tmpdir_path}/chunks", f"{tmpdir_path}/emb")
    ix = index_embeddings(spark, f"{tmpdir_path}/emb", f"{tmpdir_path}/index")
    assert ix.count() == 5
    index_embeddings(spark, f"{tmpdir_path}/emb", f"{tmpdir_path}/index")
    assert ix.count() == 5
    text = retrieve_job(spark, f"{tmpdir_path}/index", "503 nosrv error", severity="error", as_text=True)
    assert text.startswith('Consulta: "503 nosrv error"') and "#1  score=" in text
    rep = validate_corpus(spark, [f"{logs}/haproxy_a.log", f"{logs}/missing.log"], f"{tmpdir_path}/index")
    assert rep["skipped_files"] == [f"{logs}/missing.log"]
    tot = [r for r in rep["report"].collect() if r["is_total"]][0]
    assert (tot["lines"], tot["events"], tot["chunks"], tot["embeddings"]) == (50, 30, 2, 2)
    assert set(rep["seconds"]) == {"t_parse", "t_chunk", "t_embed", "t_index"}


def test_streaming_ingest_processes_each_file_once(spark, tmpdir_path):
    logs, out = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    write(f"{logs}/haproxy_1.log", [L1, L2, L4])
    write(f"{logs}/haproxy_2.log", [L3, L3])
    ck = f"{tmpdir_path}/ck"
    q = start_ingest(spark, logs, out, Params(chunk_size=2, chunk_overlap=0), checkpoint=ck)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/events").count() == 4
    write(f"{logs}/haproxy_3.log", [L1])
    q = start_ingest(spark, logs, out, Params(chunk_size=2, chunk_overlap=0), checkpoint=ck)
    q.awaitTermination(120)
    ev = spark.read.parquet(f"{out}/events")
    assert ev.count() == 5
    got = {(r["source_file"], r["line_number"]) for r in ev.collect()}
    assert ("haproxy_1.log", 2) in got and ("haproxy_3.log", 1) in got
    assert spark.read.parquet(f"{out}/chunks").count() == 1 + 1 + 1


def test_classify_files_reads_each_kind_separately(spark, tmpdir_path):
    from logevidence.plans.jobs import classify_files

    logs = f"{tmpdir_path}/mixed"
    write(f"{logs}/edge.log", [L1, L2])                                    # content -> haproxy
    write(f"{logs}/web.log", ["#Software: X", "#Fields: date time sc-status", "2026-03-03 09:00:01 404"])
    write(f"{logs}/iis_named.log", ["#Fields: date time sc-status", "2026-03-03 09:00:01 500"])
    cl = classify_files(spark, logs)
    got = {(r["source_file"], r["source"]) for r in cl.select("source_file", "source").distinct().collect()}
    assert got == {("edge.log", "haproxy"), ("web.log", "iis"), ("iis_named.log", "iis")}
    assert cl.where("status = 'ok'").count() == 4


def test_stage_files_of_the_original_layout(spark, tmpdir_path):
    import json

    from logevidence.schemas import EVENT_FIELDS

    proc = f"{tmpdir_path}/processed"
    os.makedirs(proc)
    base = {k: None for k in EVENT_FIELDS} | {"source": "haproxy", "severity": "info", "source_file": "web.log"}
    with open(f"{proc}/web.events.jsonl", "w") as fh:
        for i in range(1, 11):
            fh.write(json.dumps(base | {"line_number": i, "raw": f"r{i}"}) + "\n\n")
    ch = chunk_logs(spark, proc, f"{tmpdir_path}/ch", Params(chunk_size=4, chunk_overlap=1), input_format="stage")
    got = sorted((r["chunk_id"], r["line_start"], r["line_end"]) for r in ch.collect())
    assert got == [("web-0", 1, 4), ("web-1", 4, 7), ("web-2", 7, 10)]


def test_stages_without_input_fail(spark, tmpdir_path):
    import pytest

    os.makedirs(f"{tmpdir_path}/empty")
    with pytest.raises(FileNotFoundError):
        chunk_logs(spark, f"{tmpdir_path}/empty", f"{tmpdir_path}/o", input_format="stage")
    with pytest.raises(FileNotFoundError):
        chunk_logs(spark, f"{tmpdir_path}/missing", f"{tmpdir_path}/o", input_format="stage")


def test_batch_retrieval_job_and_report(spark, tmpdir_path):
    import json

    from logevidence.plans.jobs import retrieve_batch_job, write_report

    logs = f"{tmpdir_path}/logs"
    write(f"{logs}/haproxy_a.log", [L1, L2, L3, L1, L2] * 6)
    parse_logs(spark, logs, f"{tmpdir_path}/events")
    chunk_logs(spark, f"{tmpdir_path}/events", f"{tmpdir_path}/chunks", Params(chunk_size=5, chunk_overlap=1))
    embed_chunks_job(spark, f"{tmpdir_path}/chunks", f"{tmpdir_path}/emb")
    index_embeddings(spark, f"{tmpdir_path}/emb", f"{tmpdir_path}/index")
    qs = spark.createDataFrame([("a", "503 nosrv"), ("b", "get 200"), ("c", "   ")], "query_id string, query string")
    res = retrieve_batch_job(spark, f"{tmpdir_path}/index", qs, params=Params(top_k=2)).collect()
    assert sorted((r["query_id"], r["rank"]) for r in res) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    rep = validate_corpus(spark, [f"{logs}/haproxy_a.log"], f"{tmpdir_path}/index2")
    write_report(rep["report"], f"{tmpdir_path}/report")
    rows = [json.loads(line) for f in os.listdir(f"{tmpdir_path}/report") if f.endswith(".json")
            for line in open(f"{tmpdir_path}/report/{f}")]
    assert sum(r["is_total"] for r in rows) == 1 and len(rows) == 2


def test_validation_and_parsing_refuse_hidden_logs(spark, tmpdir_path):
    write(f"{tmpdir_path}/a/_archive/haproxy_a.log", [L1])
    write(f"{tmpdir_path}/a/haproxy_b.log", [L2])
    write(f"{tmpdir_path}/b/_access.log", [L1])
    deep = Params(recursive=True)
    for call in (
        lambda: parse_logs(spark, f"{tmpdir_path}/a", f"{tmpdir_path}/events", deep),
        lambda: validate_corpus(spark, f"{tmpdir_path}/a", f"{tmpdir_path}/index", deep),
        lambda: validate_corpus(spark, f"{tmpdir_path}/b", f"{tmpdir_path}/index"),
        lambda: validate_corpus(spark, [f"{tmpdir_path}/b/_access.log", f"{tmpdir_path}/a/haproxy_b.log"], f"{tmpdir_path}/index"),
    ):
        with pytest.raises(ValueError, match="does not read"):
            call()
    assert parse_logs(spark, f"{tmpdir_path}/a", f"{tmpdir_path}/events").stats.where("is_total").first()["files"] == 1
