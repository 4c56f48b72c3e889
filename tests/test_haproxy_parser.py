from helpers import lines_df

from logevidence.operators.haproxy import haproxy_events

L1 = ('Mar 03 09:00:01 lb9 haproxy[77]: 192.0.2.1:40001 [03/Mar/2026:09:00:01.500] fe be_x/s1 '
      '0/0/1/5/6 200 900 - - ---- 1/1/0/0/0 0/0 "GET /a HTTP/1.1"')
L2 = ('Mar 03 09:00:02 lb9 haproxy[77]: 192.0.2.2:40002 [03/Mar/2026:09:00:02.001] fe~ be_x/<NOSRV> '
      '0/-1/-1/-1/-1 503 210 - - SC-- 1/1/0/0/0 0/0 {h.example} "POST /b HTTP/1.1"')
L3 = ('Mar 03 09:00:03 lb9 haproxy[77]: 192.0.2.3:40003 [03/Mar/2026:09:00:03.000] fe be_x/s1 '
      '0/0/0/0/0 400 0 - - ---- 1/1/0/0/0 0/0 {h} {n} ""')
L4 = "not-a-haproxy-line"


def parse(spark, rows):
    return {r["line_number"]: r for r in haproxy_events(lines_df(spark, rows)).collect()}


def test_full_extraction(spark):
    r = parse(spark, [L1])[1]
    assert r["status"] == "ok"
    assert r["timestamp"] == "2026-03-03T09:00:01+00:00"
    assert (r["client_ip"], r["method"], r["path"]) == ("192.0.2.1", "GET", "/a")
    assert (r["status_code"], r["bytes"], r["duration_ms"]) == (200, 900, 6)
    assert r["backend"] == "be_x/s1" and r["severity"] == "info" and r["source"] == "haproxy"
    assert r["raw"] == L1 and r["source_file"] == "x.log"


def test_nosrv_and_header_blocks(spark):
    got = parse(spark, [L1, L2, L3, L4, "", "   "])
    assert got[2]["severity"] == "error" and got[2]["backend"] == "be_x/<NOSRV>"
    assert got[2]["duration_ms"] is None and got[2]["method"] == "POST"
    assert got[3]["severity"] == "warning" and got[3]["method"] is None and got[3]["path"] is None
    assert got[4]["status"] == "error" and got[4]["timestamp"] is None
    assert got[5]["status"] == "skip" and got[6]["status"] == "skip"


def test_trailing_text_and_bad_date(spark):
    tail = L1 + " trailing words"
    bad_month = L1.replace("03/Mar/2026", "03/Mrz/2026")
    one_token = L1.replace('"GET /a HTTP/1.1"', '"GET"')
    dash = L1.replace('"GET /a HTTP/1.1"', '" - "')
    got = parse(spark, [tail, bad_month, one_token, dash])
    assert got[1]["status"] == "ok" and got[1]["path"] == "/a"
    assert got[2]["status"] == "ok" and got[2]["timestamp"] is None
    assert got[3]["method"] == "GET" and got[3]["path"] is None
    assert got[4]["method"] is None and got[4]["path"] is None


def test_three_blocks_and_ipv6_rejected(spark):
    three = L1.replace('0/0 "GET', '0/0 {a} {b} {c} "GET')
    v6 = L1.replace("192.0.2.1:40001", "[2001:db8::1]:40001")
    got = parse(spark, [three, v6])
    assert got[1]["status"] == "error" and got[2]["status"] == "error"
