from helpers import lines_df

from logevidence.operators.iis import iis_events

ROWS = [
    "#Software: X",
    "#Fields: date time cs-method cs-uri-stem cs-uri-query c-ip sc-status time-taken",
    "2026-03-03 09:00:01 GET /p id=1 192.0.2.9 500 1200",
    "2026-03-03 09:00:02 GET /q - - 404 7",
    "#Fields: date time c-ip cs-method cs-uri-stem sc-status sc-bytes",
    "2026-03-03 09:00:03 192.0.2.8 GET /r 200 55",
    "2026-03-03 09:00:04 192.0.2.8 GET",
]


def parse(spark, rows, **kw):
    return {r["line_number"]: r for r in iis_events(lines_df(spark, rows, "u_ex1.log"), **kw).collect()}


def test_header_defines_columns(spark):
    got = parse(spark, ROWS)
    assert [got[i]["status"] for i in range(1, 8)] == ["skip", "skip", "ok", "ok", "skip", "ok", "error"]
    assert got[3]["path"] == "/p?id=1" and got[3]["severity"] == "error" and got[3]["duration_ms"] == 1200
    assert got[3]["timestamp"] == "2026-03-03T09:00:01+00:00" and got[3]["bytes"] is None
    assert got[4]["path"] == "/q" and got[4]["client_ip"] is None and got[4]["severity"] == "warning"
    assert got[6]["bytes"] == 55 and got[6]["path"] == "/r" and got[6]["backend"] is None
    assert got[6]["header_line"] == 5 and got[3]["header_line"] == 2


def test_data_before_header_without_fallback_is_error(spark):
    got = parse(spark, ["2026-03-03 09:00:01 GET /p"], default_fields=())
    assert got[1]["status"] == "error"


def test_fallback_and_ignored_headers(spark):
    rows = ["2026-03-03 09:00:01 GET /p 200", "#Fields: date time", "2026-03-03 09:00:01 GET /q 404"]
    got = parse(spark, rows, default_fields=("date", "time", "cs-method", "cs-uri-stem", "sc-status"))
    assert got[1]["status"] == "ok" and got[1]["path"] == "/p"
    assert got[3]["status"] == "error"  # header now has 2 columns
    got = parse(spark, rows, default_fields=("date", "time", "cs-method", "cs-uri-stem", "sc-status"),
                fields_from_header=False)
    assert got[3]["status"] == "ok" and got[3]["status_code"] == 404


def test_duplicate_names_last_wins_and_dash_stem(spark):
    rows = ["#Fields: date time sc-status sc-status cs-uri-stem cs-uri-query", "2026-03-03 09:00:01 200 503 - q=1"]
    got = parse(spark, rows)
    assert got[2]["status_code"] == 503 and got[2]["path"] == "-?q=1"


def test_header_carry_across_slices(spark):
    rows = ["#Fields: date time sc-status"] + [f"2026-03-03 09:00:{i % 60:02d} 200" for i in range(1, 40)]
    got = {r["line_number"]: r for r in iis_events(lines_df(spark, rows), width=8).collect()}
    assert all(got[i]["status"] == "ok" and got[i]["header_line"] == 1 for i in range(2, 41))
