import json
import os

import pytest

from logevidence.schemas import EVENT_FIELDS
from logevidence.sources.jsonl import load_events, write_events, write_json_array


def events(spark):
    rows = [(None, "haproxy", "info", None, None, None, None, None, None, None, "a.log", 1, "ñ raw"),
            ("2026-01-01T00:00:00+00:00", "iis", "error", "1.2.3.4", "GET", "/x", 503, 10, 5, None, "b.log", 2, "r2")]
    schema = ("timestamp string, source string, severity string, client_ip string, method string, path string, "
              "status_code int, bytes long, duration_ms long, backend string, source_file string, "
              "line_number long, raw string")
    return spark.createDataFrame(rows, schema)


def test_roundtrip_keeps_null_keys(spark, tmpdir_path):
    out = f"{tmpdir_path}/ev"
    write_events(events(spark), out)
    parts = [os.path.join(d, f) for d, _, fs in os.walk(out) for f in fs if f.endswith(".json")]
    recs = [json.loads(line) for p in parts for line in open(p, encoding="utf-8") if line.strip()]
    assert all(list(r.keys()) == list(EVENT_FIELDS) for r in recs)
    assert any(r["raw"] == "ñ raw" and r["timestamp"] is None for r in recs)
    assert {d for d in os.listdir(out) if d.startswith("file=")} == {"file=a", "file=b"}
    back = load_events(spark, out).orderBy("line_number").collect()
    assert back[1]["status_code"] == 503 and back[0]["client_ip"] is None


def test_blank_lines_skipped_and_bad_json_fails(spark, tmpdir_path):
    p = f"{tmpdir_path}/in.events.jsonl"
    good = json.dumps({k: None for k in EVENT_FIELDS} | {"source": "haproxy", "severity": "info", "source_file": "x",
                                                        "line_number": 1, "raw": "r"})
    with open(p, "w") as fh:
        fh.write(good + "\n\n   \n" + good + "\n")
    assert load_events(spark, p).count() == 2
    with open(p, "a") as fh:
        fh.write("{not json\n")
    with pytest.raises(Exception):
        load_events(spark, p).collect()
    bad = load_events(spark, p, mode="PERMISSIVE").select("raw", "_corrupt_record").collect()
    assert sum(r["_corrupt_record"] is not None for r in bad) == 1


def test_json_array_per_file(spark, tmpdir_path):
    out = f"{tmpdir_path}/arr"
    write_json_array(events(spark), out)
    for stem in ("a", "b"):
        d = f"{out}/file={stem}"
        text = "".join(open(os.path.join(d, f), encoding="utf-8").read() for f in sorted(os.listdir(d)) if f.startswith("part-"))
        arr = json.loads(text.replace("\n", ""))
        assert isinstance(arr, list) and len(arr) == 1 and list(arr[0].keys()) == list(EVENT_FIELDS)


def test_stage_input_by_suffix(spark, tmpdir_path):
    from logevidence.sources.jsonl import stage_input

    rec = {k: None for k in EVENT_FIELDS} | {"source": "haproxy", "severity": "info", "source_file": "a.log",
                                              "line_number": 1, "raw": "r"}
    os.makedirs(f"{tmpdir_path}/proc/sub")
    with open(f"{tmpdir_path}/proc/a.events.jsonl", "w") as fh:
        fh.write(json.dumps(rec) + "\n" + json.dumps(rec | {"line_number": 2}) + "\n")
    open(f"{tmpdir_path}/proc/sub/empty.events.jsonl", "w").close()
    open(f"{tmpdir_path}/proc/other.chunks.jsonl", "w").close()
    df = stage_input(spark, f"{tmpdir_path}/proc", "events")
    assert sorted((r["stem"], r["line_number"]) for r in df.collect()) == [("a", 1), ("a", 2)]
    with pytest.raises(FileNotFoundError):
        stage_input(spark, f"{tmpdir_path}/nope", "events")
    with pytest.raises(FileNotFoundError):
        stage_input(spark, f"{tmpdir_path}/proc", "embeddings")
