import pytest
from helpers import lines_df
from test_haproxy_parser import L1, L2, L3, L4

from logevidence.operators.detect import detect_sources, resolve_source
from logevidence.operators.parse import ParseError, classify_lines, events_of, parse_stats


def test_detection_rules(spark):
    frames = [
        lines_df(spark, ["x"], "haproxy_x.log"),
        lines_df(spark, ["x"], "iis_x.log"),
        lines_df(spark, ["x"], "u_ex2401.log"),
        lines_df(spark, ["a", "#Fields: date time"], "other.log"),
        lines_df(spark, ["a"] * 10 + ["#Software: X"], "late.log"),
        lines_df(spark, ["a"], "plain.log"),
    ]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    got = {r["source_file"]: r["source"] for r in detect_sources(df).collect()}
    assert got == {"haproxy_x.log": "haproxy", "iis_x.log": "iis", "u_ex2401.log": "iis", "other.log": "iis",
                   "late.log": "haproxy", "plain.log": "haproxy"}


def test_source_precedence():
    assert resolve_source("iis", "haproxy") == "iis"
    assert resolve_source("auto", "haproxy") == "haproxy"
    assert resolve_source(None, "auto") is None
    with pytest.raises(ValueError):
        resolve_source("nginx")


def sample(spark):
    # 12 lines: 11 parse, 1 corrupt; three 503
    rows = [L1, L2, L3, L1, L2, L2, L1, L3, L1, L1, L3, L4]
    return lines_df(spark, rows, "haproxy_sample.log")


def test_skip_policy_stats(spark):
    cl = classify_lines(sample(spark))
    ev = events_of(cl, "skip")
    assert ev.count() == 11
    assert ev.where("status_code = 503").count() == 3
    st = {r["is_total"]: r for r in parse_stats(cl, "skip").collect()}
    assert (st[False]["lines"], st[False]["ok"], st[False]["skipped_errors"], st[False]["kept_errors"]) == (12, 11, 1, 0)
    assert (st[True]["files"], st[True]["events"]) == (1, 11)


def test_keep_policy_placeholder(spark):
    ev = events_of(classify_lines(sample(spark)), "keep").orderBy("line_number").collect()
    assert len(ev) == 12
    last = ev[-1]
    assert last["status_code"] is None and last["severity"] == "info" and last["source"] == "haproxy"
    assert last["raw"] == L4 and last["line_number"] == 12 and last["timestamp"] is None


def test_fail_policy_names_first_offender(spark):
    with pytest.raises(ParseError, match="haproxy_sample.log:12"):
        events_of(classify_lines(sample(spark)), "fail")
    assert events_of(classify_lines(lines_df(spark, [L1])), "fail").count() == 1


def test_mixed_corpus(spark):
    iis = lines_df(spark, ["#Fields: date time sc-status", "2026-03-03 09:00:01 503"], "w3svc.log")
    cl = classify_lines(sample(spark).unionByName(iis))
    got = {(r["source_file"], r["source"]) for r in cl.select("source_file", "source").distinct().collect()}
    assert got == {("haproxy_sample.log", "haproxy"), ("w3svc.log", "iis")}
    assert events_of(cl).where("source = 'iis'").first()["severity"] == "error"
