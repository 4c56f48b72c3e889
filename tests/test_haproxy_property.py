"""The single-pass Spark parser against a brute-force Python reading of the same grammar."""
import re

from helpers import lines_df
from hypothesis import given, settings
from hypothesis import strategies as st

from logevidence.operators.haproxy import HAPROXY_HTTP, haproxy_events

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
PY = re.compile(HAPROXY_HTTP)


def brute(raw):
    """Plain Python semantics: anchored match, split-based date and request handling."""
    if not raw.strip():
        return ("skip",)
    m = PY.match(raw)
    if m is None:
        return ("error",)
    ip, accept, be, srv, tt, status, nbytes, request = m.groups()
    ts = None
    try:
        date_part, time_part = accept.split(":", 1)
        d, mon, y = date_part.split("/")
        if mon in MONTHS:
            ts = f"{int(y):04d}-{MONTHS.index(mon) + 1:02d}-{int(d):02d}T{time_part.split('.')[0]}+00:00"
    except ValueError:
        ts = None
    req = request.strip()
    if not req or req == "-":
        method = path = None
    else:
        parts = req.split()
        method, path = parts[0], (parts[1] if len(parts) > 1 else None)
    t = int(tt)
    return ("ok", ts, ip, method, path, int(status), int(nbytes), t if t >= 0 else None, f"{be}/{srv}")


sp = st.sampled_from([" ", "  ", "\t"])
tok = st.text(alphabet="abcXYZ019-_~.<>", min_size=1, max_size=6)
date = st.one_of(
    st.builds(lambda d, m, y, h: f"{d}/{m}/{y}:{h}", st.integers(0, 40), st.sampled_from(MONTHS + ["Mrz", "jan"]),
              st.integers(1, 3000), st.sampled_from(["09:00:01.5", "9:0:1", "09:00:01", "x.y", ""])),
    st.sampled_from(["03/Mar/2026", "a/b/c/d:1", "nocolon", "03/Mar:2026:1"]),
)
request = st.one_of(
    st.sampled_from(["", "-", " - ", "GET", "GET /a HTTP/1.1", "  POST   /b/c?x=1  HTTP/2 extra ", "\tX\t/y"]),
    st.builds(lambda a, b: f"{a} {b}", tok, tok),
)


@st.composite
def line(draw):
    s = draw(sp)
    hdrs = "".join("{" + draw(tok) + "}" + draw(sp) for _ in range(draw(st.integers(0, 3))))
    tt = draw(st.sampled_from(["6", "-1", "0", "12345"]))
    status = draw(st.sampled_from(["200", "503", "404", "99", "5000"]))
    parts = [
        f"{draw(st.sampled_from(['Mar', 'Jan']))}{s}{draw(st.integers(1, 31))} 09:00:01{s}lb{s}haproxy[{draw(st.integers(1, 99))}]:{s}",
        f"{draw(st.sampled_from(['192.0.2.1', '10.0.0.7', '::1']))}:{draw(st.integers(1, 65000))}{s}",
        f"[{draw(date)}]{s}{draw(tok)}{s}{draw(tok)}/{draw(tok)}{s}0/0/1/5/{tt}{s}{status}{s}{draw(st.integers(0, 10**6))}{s}",
        f"-{s}-{s}----{s}1/1/0/0/0{s}0/0{s}{hdrs}\"{draw(request)}\"",
        draw(st.sampled_from(["", " trailing", "\" junk"])),
    ]
    return "".join(parts)


@settings(max_examples=30, deadline=None)
@given(st.lists(line(), min_size=20, max_size=20))
def test_parser_matches_brute_force(spark, rows):
    got = {r["line_number"]: r for r in haproxy_events(lines_df(spark, rows)).collect()}
    for i, raw in enumerate(rows, start=1):
        want = brute(raw)
        r = got[i]
        assert r["status"] == want[0], raw
        if want[0] == "ok":
            have = ("ok", r["timestamp"], r["client_ip"], r["method"], r["path"], r["status_code"], r["bytes"],
                    r["duration_ms"], r["backend"])
            assert have == want, raw
