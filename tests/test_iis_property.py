"""IIS parsing (header as-of + field mapping) against a sequential brute-force reading."""
from helpers import lines_df
from hypothesis import given, settings
from hypothesis import strategies as st

from logevidence.operators.iis import iis_events

DEFAULT = ["date", "time", "cs-method", "cs-uri-stem", "sc-status"]
NAMES = ["date", "time", "c-ip", "cs-method", "cs-uri-stem", "cs-uri-query", "sc-status", "sc-bytes", "time-taken",
         "s-port"]


def to_int(v):
    if v is None or v == "-":
        return None
    try:
        return int(v)
    except ValueError:
        return None


def iso(d, t):
    if not d or not t or d == "-" or t == "-":
        return None
    try:
        y, m, dd = d.split("-")
        hh, mi, ss = t.split(":")
        return f"{int(y):04d}-{int(m):02d}-{int(dd):02d}T{int(hh):02d}:{int(mi):02d}:{int(ss):02d}+00:00"
    except ValueError:
        return None


def brute(rows, default):
    fields, out = None, {}
    for i, raw in enumerate(rows, start=1):
        if not raw.strip():
            out[i] = ("skip",)
            continue
        if raw.startswith("#"):
            if raw.lower().startswith("#fields:"):
                fields = raw.split(":", 1)[1].split()
            out[i] = ("skip",)
            continue
        f = fields if fields else default
        vals = raw.split()
        if not f or len(vals) != len(f):
            out[i] = ("error",)
            continue
        row = dict(zip(f, vals))
        path, q = row.get("cs-uri-stem"), row.get("cs-uri-query")
        if path and q and q != "-":
            path = f"{path}?{q}"
        out[i] = ("ok", iso(row.get("date", ""), row.get("time", "")),
                  None if row.get("c-ip") in (None, "-") else row.get("c-ip"),
                  None if row.get("cs-method") in (None, "-") else row.get("cs-method"),
                  path, to_int(row.get("sc-status")), to_int(row.get("sc-bytes")), to_int(row.get("time-taken")))
    return out


value = st.sampled_from(["-", "GET", "/p", "a=1", "2026-03-03", "2026-3-3", "09:00:01", "9:0:1", "x:y:z", "200",
                         "503", "4.5", "1200", "192.0.2.9", "2026-03"])


@st.composite
def iis_file(draw):
    rows = []
    for _ in range(draw(st.integers(5, 25))):
        kind = draw(st.sampled_from(["data", "data", "data", "header", "comment", "blank"]))
        if kind == "header":
            names = draw(st.lists(st.sampled_from(NAMES), min_size=0, max_size=6))
            rows.append(draw(st.sampled_from(["#Fields: ", "#fields:", "#FIELDS:  "])) + " ".join(names))
        elif kind == "comment":
            rows.append(draw(st.sampled_from(["#Software: X", "#Date: 2026", "# note"])))
        elif kind == "blank":
            rows.append(draw(st.sampled_from(["", "  ", "\t"])))
        else:
            n = draw(st.integers(1, 7))
            rows.append(draw(st.sampled_from([" ", "  "])).join(draw(value) for _ in range(n)))
    return rows


@settings(max_examples=25, deadline=None)
@given(iis_file(), st.booleans())
def test_iis_matches_brute_force(spark, rows, with_default):
    default = DEFAULT if with_default else []
    got = {r["line_number"]: r for r in iis_events(lines_df(spark, rows), default_fields=default, width=4).collect()}
    want = brute(rows, default)
    for i in want:
        r = got[i]
        assert r["status"] == want[i][0], (i, rows)
        if want[i][0] == "ok":
            have = ("ok", r["timestamp"], r["client_ip"], r["method"], r["path"], r["status_code"], r["bytes"],
                    r["duration_ms"])
            assert have == want[i], (i, rows)
