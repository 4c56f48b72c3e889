"""Bad input named by file and line: JSON records of each stage, unparseable log lines under ``fail``."""
import glob
import json
import os

import pytest
from test_haproxy_parser import L1, L2, L3, L4
from test_streaming_and_jobs import write

from logevidence.config import Params
from logevidence.operators.parse import ParseError
from logevidence.plans.jobs import chunk_logs, embed_chunks_job, index_embeddings, parse_logs
from logevidence.schemas import EVENT, EVENT_FIELDS
from logevidence.session import shared_dir
from logevidence.sources.jsonl import RecordError, bad_records

EVENT_LINE = json.dumps(dict.fromkeys(EVENT_FIELDS) | {"source": "iis", "severity": "info", "source_file": "a.log", "line_number": 1, "raw": "r"})
JOBS = {
    "events": (chunk_logs, EVENT_LINE),
    "chunks": (embed_chunks_job, '{"chunk_id": "a-0", "source_file": "a.log", "text": "x"}'),
    "embeddings": (index_embeddings, '{"chunk_id": "a-0", "embedding": [1.0, 0.0], "embedding_model": "m", "embedding_dim": 2}'),
}


@pytest.mark.parametrize("stage", list(JOBS))
@pytest.mark.parametrize("layout", ["jsonl", "stage"])
def test_error_names_file_and_line(spark, tmpdir_path, stage, layout):
    job, good = JOBS[stage]
    folder = f"{tmpdir_path}/in"
    write(f"{folder}/x.{stage}.jsonl", [good, "", good, '{"chunk_id": ', good, "[1"])
    write(f"{folder}/y.{stage}.jsonl", ["not a record"])
    with pytest.raises(RecordError, match=rf"x\.{stage}\.jsonl:4 "):
        job(spark, folder, f"{tmpdir_path}/out", input_format=layout)


def test_other_errors_stay_as_they_are(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/in")
    with pytest.raises(FileNotFoundError):
        chunk_logs(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/out", input_format="stage")


def test_bad_records_counts_lines_as_the_reader_does(spark, tmpdir_path):
    # A line separator inside a string is no line boundary of JSON Lines; a carriage return is one.
    path = f"{tmpdir_path}/in/a.jsonl"
    os.makedirs(os.path.dirname(path))
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(EVENT_LINE.replace('"r"', '"one two\x85three"') + "\r\n" + EVENT_LINE + "\r" + "oops\n  \n" + '{"status_code": "abc"}\n')
    got = [(r["source_file"], r["line_number"], r["raw"]) for r in bad_records(spark, f"{tmpdir_path}/in", EVENT).orderBy("line_number").collect()]
    assert got == [("a.jsonl", 3, "oops"), ("a.jsonl", 5, '{"status_code": "abc"}')]


def test_bad_records_of_empty_files(spark, tmpdir_path):
    write(f"{tmpdir_path}/in/a.jsonl", [""])
    assert bad_records(spark, f"{tmpdir_path}/in", EVENT).count() == 0


def test_fail_policy_writes_nothing(spark, tmpdir_path):
    logs = f"{tmpdir_path}/logs"
    write(f"{logs}/haproxy_a.log", [L1, L2, L3])
    write(f"{logs}/haproxy_b.log", [L1, "", L4, L3, L4])
    params = Params(on_parse_error="fail")
    scratch = os.path.dirname(shared_dir(spark, "any")).removeprefix("file:")
    tables = lambda: set(glob.glob(f"{scratch}/classified-lines-*/*.parquet"))
    before = tables()
    with pytest.raises(ParseError, match="haproxy_b.log:3 "):
        parse_logs(spark, logs, f"{tmpdir_path}/events", params)
    assert not os.path.exists(f"{tmpdir_path}/events")
    assert tables() == before


@pytest.mark.parametrize("policy", ["skip", "keep"])
def test_totals_are_counted_while_writing(spark, tmpdir_path, policy):
    logs = f"{tmpdir_path}/logs"
    write(f"{logs}/haproxy_a.log", [L1, L2, L4, "", L3] * 7)
    write(f"{logs}/iis_b.log", ["#Fields: date time sc-status cs-uri-stem", "2026-03-03 09:00:01 503 /x"])
    res = parse_logs(spark, logs, f"{tmpdir_path}/events", Params(on_parse_error=policy))
    total = res.stats.where("is_total").first()
    assert res.totals == {c: total[c] for c in ("lines", "ok", "skipped_errors", "kept_errors", "events")}
    assert res.totals["lines"] == 37 and res.totals["ok"] == 22
