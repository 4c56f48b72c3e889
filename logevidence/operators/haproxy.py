"""P-01..P-04, P-10, P-12: HAProxy HTTP-log lines to event columns.

One regex pass per line: ``regexp_replace`` rewrites a matching line into its
captured groups joined by line feeds, which no line has (a non-matching line collapses to the bare
separators), then ``split`` hands the groups out. Everything stays inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MONTHS, TZ_SUFFIX
from ..functions.text import WS_CLASS, is_blank
from ..schemas import EVENT_FIELDS

# ---------------------------------------------------------------------------
# Fixed value: the HAProxy HTTP log grammar the original tool accepts. Anchored
# at the start only (trailing text allowed); 0 to 2 captured-header blocks.
#   syslog "Mon DD HH:MM:SS" host "haproxy[pid]:" client_ip:port [accept_date]
#   frontend backend/server Tq/Tw/Tc/Tr/Tt status bytes req_cookie res_cookie
#   term_state actconn/feconn/beconn/srv/retries srv_queue/backend_queue
#   {hdrs}? {hdrs}? "request"
HAPROXY_HTTP = (
    r"\w{3}\s+\d+\s[\d:]{8}\s+"
    r"\S+\s+"
    r"haproxy\[\d+\]:\s+"
    r"([\d.]+):\d+\s+"
    r"\[([^\]]+)\]\s+"
    r"\S+\s+"
    r"([^/]+)/(\S+)\s+"
    r"-?\d+/-?\d+/-?\d+/-?\d+/(-?\d+)\s+"
    r"(\d{3})\s+"
    r"(\d+)\s+"
    r"\S+\s+\S+\s+"
    r"\S+\s+"
    r"\d+/\d+/\d+/\d+/\d+\s+"
    r"\d+/\d+\s+"
    r"(?:\{[^}]*\}\s+){0,2}"
    r'"([^"]*)"'
)
# ---------------------------------------------------------------------------

# The same grammar with extra capture groups, so one regex pass also splits the
# accept date (day/month/year before the first ':', time up to the first '.')
# and the first two whitespace-separated request tokens (method, path).
_W = WS_CLASS
_NW = "[^" + WS_CLASS[1:-1] + '"]'
_ACCEPT = r"\[(?=[^\]])(?:([^:/\]]*)/([^:/\]]*)/([^:/\]]*):([^.\]]*))?[^\]]*\]\s+"
_REQUEST = '"' + _W + "*(" + _NW + "*)(?:" + _W + "+(" + _NW + "*))?" + '[^"]*"'
_PARSE = HAPROXY_HTTP.replace(r"\[([^\]]+)\]\s+", _ACCEPT).replace('"([^"]*)"', _REQUEST)
assert _PARSE != HAPROXY_HTTP
_GROUPS = ("client_ip", "day", "mon", "year", "hms", "backend", "server", "tt", "status", "bytes", "method", "path")
_SEP = "\n"
_REWRITE = "(?s)^(?:" + _PARSE + ".*|.*)"
_REPLACEMENT = _SEP.join(f"${i + 1}" for i in range(len(_GROUPS)))


def _sql_projection(source_expr: str, keep: list[str]) -> list[str]:
    g = {n: f"get(__g, {i})" for i, n in enumerate(_GROUPS)}
    matched = f"(NOT __blank AND coalesce({g['client_ip']}, '') <> '')"
    status = f"try_cast({g['status']} AS INT)"
    tt = f"try_cast({g['tt']} AS BIGINT)"
    no_request = f"({g['path']} = '' AND ({g['method']} = '' OR {g['method']} = '-'))"
    months = ", ".join(f"'{m}', {i + 1}" for i, m in enumerate(MONTHS))
    day, year = f"try_cast({g['day']} AS INT)", f"try_cast({g['year']} AS INT)"
    month = f"try_element_at(map({months}), {g['mon']})"
    iso = (f"CASE WHEN {day} IS NOT NULL AND {month} IS NOT NULL AND {year} IS NOT NULL THEN "
           f"concat(format_string('%04d-%02d-%02d', {year}, {month}, {day}), 'T', {g['hms']}, '{TZ_SUFFIX}') END")
    sev = (f"CASE WHEN {status} BETWEEN 500 AND 599 THEN 'error' "
           f"WHEN {status} BETWEEN 400 AND 499 THEN 'warning' ELSE 'info' END")

    def ok(expr: str, name: str) -> str:
        return f"CASE WHEN {matched} THEN {expr} END AS `{name}`"

    return [
        *[f"`{c}`" for c in keep],
        f"CASE WHEN __blank THEN 'skip' WHEN {matched} THEN 'ok' ELSE 'error' END AS status",
        ok(iso, "timestamp"),
        f"{source_expr} AS source",
        f"CASE WHEN {matched} THEN {sev} ELSE 'info' END AS severity",
        ok(g["client_ip"], "client_ip"),
        ok(f"CASE WHEN NOT {no_request} THEN {g['method']} END", "method"),
        ok(f"CASE WHEN NOT {no_request} AND {g['path']} <> '' THEN {g['path']} END", "path"),
        ok(status, "status_code"),
        ok(f"try_cast({g['bytes']} AS BIGINT)", "bytes"),
        ok(f"CASE WHEN {tt} >= 0 THEN {tt} END", "duration_ms"),
        ok(f"concat({g['backend']}, '/', {g['server']})", "backend"),
        "source_file",
        "line_number",
        "raw",
        "CAST(NULL AS BIGINT) AS header_line",
    ]


def haproxy_events(lines: DataFrame, source_col: str | None = None) -> DataFrame:
    """Add ``status`` (ok/skip/error) and the 13 event columns to a lines frame.

    Keeps every input row; non-``ok`` rows carry null event fields.
    """
    raw = F.col("raw")
    groups = F.split(F.regexp_replace(raw, _REWRITE, _REPLACEMENT), _SEP, -1)
    # explode of a one-element array: the regex runs once per line and its groups
    # are a materialised column (projections would otherwise inline it per field).
    parts = lines.select(*lines.columns, is_blank(raw).alias("__blank"), F.explode(F.array(groups)).alias("__g"))
    keep = [c for c in lines.columns if c not in EVENT_FIELDS and c not in ("status", "__g", "header_line")]
    source_expr = f"`{source_col}`" if source_col else "'haproxy'"
    return parts.selectExpr(*_sql_projection(source_expr, keep))


__all__ = ["HAPROXY_HTTP", "haproxy_events"]
