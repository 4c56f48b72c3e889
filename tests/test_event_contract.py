"""13-key event contract for both sources: order, non-null core fields, nulls kept through JSON."""
import json
import os

from helpers import lines_df
from test_haproxy_parser import L1, L2, L3, L4
from test_iis_parser import ROWS

from logevidence.operators.parse import classify_lines, events_of
from logevidence.schemas import EVENT_FIELDS
from logevidence.sources.jsonl import load_events, write_events

CORE = ("source", "severity", "source_file", "line_number", "raw")


def both(spark):
    hap = lines_df(spark, [L1, L2, L3, L4], "haproxy_x.log")
    iis = lines_df(spark, ROWS, "u_ex1.log")
    return events_of(classify_lines(hap.unionByName(iis)), "keep").select(*EVENT_FIELDS)


def test_keys_order_and_core_fields(spark):
    ev = both(spark)
    assert tuple(ev.columns) == EVENT_FIELDS
    rows = ev.collect()
    assert {r["source"] for r in rows} == {"haproxy", "iis"}
    assert all(r[c] is not None for r in rows for c in CORE)
    assert all(r["backend"] is None for r in rows if r["source"] == "iis")


def test_json_roundtrip_keeps_every_key(spark, tmpdir_path):
    ev = both(spark)
    write_events(ev, f"{tmpdir_path}/ev")
    for d, _, files in os.walk(f"{tmpdir_path}/ev"):
        for f in files:
            if f.endswith(".json"):
                for line in open(os.path.join(d, f), encoding="utf-8"):
                    assert list(json.loads(line)) == list(EVENT_FIELDS)
    back = load_events(spark, f"{tmpdir_path}/ev").select(*EVENT_FIELDS)
    key = lambda r: (r["source_file"], r["line_number"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, ev.collect()), key=str)
