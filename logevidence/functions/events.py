"""Event-level column expressions: severity, ISO timestamps, rendering, citations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MONTHS, TZ_SUFFIX
from .text import col_



def _month_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(m), F.lit(i + 1)) for i, m in enumerate(MONTHS)))


def severity_of(status: str | Column) -> Column:
    """P-13: 500-599 error, 400-499 warning, anything else (null included) info."""
    s = col_(status)
    return (
        F.when(s.between(500, 599), F.lit("error"))
        .when(s.between(400, 499), F.lit("warning"))
        .otherwise(F.lit("info"))
    )


def haproxy_iso_parts(day_s: Column, mon_s: Column, year_s: Column, hms: Column) -> Column:
    """P-10 from the already split accept-date parts (day, month name, year, time)."""
    day, year = day_s.try_cast("int"), year_s.try_cast("int")
    month = F.try_element_at(_month_map(), mon_s)
    ok = day.isNotNull() & month.isNotNull() & year.isNotNull()
    iso = F.concat(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("T"), hms, F.lit(TZ_SUFFIX))
    return F.when(ok, iso)


def iis_iso(date_s: str | Column, time_s: str | Column) -> Column:
    """P-11: IIS ``date`` + ``time`` to ISO text; empty or ``-`` parts give null."""
    d, t = col_(date_s), col_(time_s)
    dp = F.split(d, "-", -1)
    tp = F.split(t, ":", -1)
    y, m, dd = (F.get(dp, i).try_cast("int") for i in range(3))
    hh, mi, ss = (F.get(tp, i).try_cast("int") for i in range(3))
    ok = (
        d.isNotNull() & t.isNotNull() & (d != "") & (t != "") & (d != "-") & (t != "-")
        & (F.size(dp) == 3) & (F.size(tp) == 3)
        & y.isNotNull() & m.isNotNull() & dd.isNotNull() & hh.isNotNull() & mi.isNotNull() & ss.isNotNull()
    )
    iso = F.concat(F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", y, m, dd, hh, mi, ss), F.lit(TZ_SUFFIX))
    return F.when(ok, iso)


def render_event_line(prefix: str = "") -> Column:
    """P-18: ``[ts] source severity method path status <dur>ms backend``, nulls as ``-``."""
    c = lambda n: f"{prefix}{n}"
    dash = lambda n: f"coalesce(CAST({c(n)} AS STRING), '-')"
    return F.expr(
        f"concat_ws(' ', concat('[', {dash('timestamp')}, ']'), {dash('source')}, {dash('severity')}, "
        f"{dash('method')}, {dash('path')}, {dash('status_code')}, "
        f"CASE WHEN {c('duration_ms')} IS NULL THEN '-' ELSE concat({c('duration_ms')}, 'ms') END, "
        f"{dash('backend')})"
    )


def citation(source_file: str | Column = "source_file", line_start: str | Column = "line_start",
             line_end: str | Column = "line_end") -> Column:
    """P-20: ``source_file:line_start-line_end`` (Python ``None`` renders as ``None``)."""
    def py(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(py(col_(source_file)), F.lit(":"), py(col_(line_start)), F.lit("-"), py(col_(line_end)))


def severity_counts_map(info: str | Column, warning: str | Column, error: str | Column) -> Column:
    """P-24: rebuild the severities map from the flat counters, keeping only counts > 0."""
    m = F.create_map(
        F.lit("info"), col_(info).cast("int"),
        F.lit("warning"), col_(warning).cast("int"),
        F.lit("error"), col_(error).cast("int"),
    )
    return F.map_filter(m, lambda k, v: F.coalesce(v, F.lit(0)) > 0)


def severities_text(sev: str | Column, kv_sep: str = ":", sep: str = ", ", empty: str = "-") -> Column:
    """Render a severities map as ``k:v, k:v`` (``-`` when empty)."""
    m = col_(sev)
    txt = F.array_join(
        F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(kv_sep), e["value"].cast("string"))), sep
    )
    return F.when(F.coalesce(F.size(m), F.lit(0)) > 0, txt).otherwise(F.lit(empty))
