"""P-05..P-09, P-11 and J-01: IIS W3C lines to event columns.

The ``#Fields:`` directive in force for a line is the latest one above it in the
same file (an as-of join by line number). Directives are rare, so they alone are
grouped: by slices of a file's lines, the last ones of slices by slices of
slices, and the last ones of those by file. The three tables are looked up once
per slice, not per line; a line then looks up its slice. The lines are shuffled
once at most, by slices, so that no task has a whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_IIS_FIELDS, TZ_SUFFIX
from ..functions.text import is_blank, split_ws_nonempty
from ..schemas import EVENT_FIELDS

DASH = "-"

# Lines of a slice, and slices of a slice of slices: the directives that a line
# compares itself with are at most so many a table.
IIS_WIDTH = 1 << 10


def _key(lines: DataFrame) -> str:
    return "source_path" if "source_path" in lines.columns else "source_file"


def _header_names(raw: Column) -> Column:
    return split_ws_nonempty(F.substring(raw, F.instr(raw, ":") + 1, 1 << 30))


def active_headers(lines: DataFrame, width: int = IIS_WIDTH) -> DataFrame:
    """J-01: add ``header_line`` and ``header_fields`` = the ``#Fields:`` directive in force (or null).

    The field list is split once, on the header row itself.
    """
    key = _key(lines)
    raw, line = F.col("raw"), F.col("line_number")
    is_hdr = raw.startswith("#") & F.lower(raw).startswith("#fields:")
    heads = lines.where(is_hdr).select(
        F.col(key).alias("__k"), line.alias("l"), _header_names(raw).alias("f"), F.floor(line / width).alias("__s1"))

    def grouped(rows: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
        """Per group its directives in the order of ``at``."""
        return rows.groupBy("__k", *by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "l", "f"))).alias(name))

    def last_of(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        last = F.element_at(F.col(name), -1)
        return rows.select("__k", *by, last["l"].alias("l"), last["f"].alias("f"))

    def latest(name: str, before: Column) -> Column:
        return F.try_element_at(F.filter(name, lambda e: e["at"] < before), F.lit(-1))

    in_slice = grouped(heads, ["__s1"], "l", "__a1")
    slices = last_of(in_slice, ["__s1"], "__a1").withColumn("__s2", F.floor(F.col("__s1") / width))
    in_slices = grouped(slices, ["__s2"], "__s1", "__a2")
    in_file = grouped(last_of(in_slices, ["__s2"], "__a2"), [], "__s2", "__a3")

    s1, s2 = F.floor(line / width), F.floor(F.floor(line / width) / width)
    keyed = lines.withColumns({"__k": F.col(key), "__s1": s1})
    # One row per slice that has lines: its own directives and the latest one before it.
    known = (
        keyed.select("__k", "__s1", s2.alias("__s2")).distinct()
        .join(in_slice, ["__k", "__s1"], "left")
        .join(in_slices, ["__k", "__s2"], "left")
        .select("__k", "__s1", "__s2", "__a1", latest("__a2", F.col("__s1")).alias("__b2"))
        .join(in_file, ["__k"], "left")
    )
    known = known.select("__k", "__s1", "__a1", F.coalesce("__b2", latest("__a3", F.col("__s2"))).alias("__b"))
    out = keyed.join(known, ["__k", "__s1"], "left").withColumn("__h", F.coalesce(latest("__a1", line + 1), F.col("__b")))
    return out.select(*lines.columns, F.col("__h.l").alias("header_line"), F.col("__h.f").alias("header_fields"))


def iis_events(
    lines: DataFrame,
    default_fields: Sequence[str] = DEFAULT_IIS_FIELDS,
    fields_from_header: bool = True,
    source_col: str | None = None,
    width: int = IIS_WIDTH,
) -> DataFrame:
    """Add ``status`` (ok/skip/error) and the 13 event columns to an IIS lines frame."""
    default = "CAST(array(" + ", ".join("'" + f.replace("'", "''") + "'" for f in default_fields) + ") AS ARRAY<STRING>)"
    if fields_from_header:
        hdr = active_headers(lines, width)
        fields = f"CASE WHEN header_fields IS NOT NULL AND size(header_fields) > 0 THEN header_fields ELSE {default} END"
    else:
        hdr = lines.withColumn("header_line", F.lit(None).cast("long"))
        fields = default
    wanted = ("date", "time", "c-ip", "cs-method", "cs-uri-stem", "cs-uri-query", "sc-status", "sc-bytes",
              "time-taken")
    # Step 1: reversed field names and values (a repeated name keeps its last value).
    step1 = hdr.select(
        *hdr.columns,
        F.expr(f"reverse({fields})").alias("__rf"),
        F.reverse(split_ws_nonempty(F.col("raw"))).alias("__rv"),
        is_blank(F.col("raw")).alias("__blank"),
    )
    # Step 2: every wanted value looked up once.
    step2 = step1.selectExpr(
        *[f"`{c}`" for c in hdr.columns], "__blank",
        "size(__rf) > 0 AS __has_fields", "size(__rf) = size(__rv) AS __same_n",
        *[f"get(__rv, CAST(array_position(__rf, '{n}') AS INT) - 1) AS `__{i}`" for i, n in enumerate(wanted)],
    )
    v = {n: f"`__{i}`" for i, n in enumerate(wanted)}
    directive = "startswith(raw, '#')"
    matched = f"(NOT __blank AND NOT {directive} AND __has_fields AND __same_n)"
    stem, query = v["cs-uri-stem"], v["cs-uri-query"]
    path = (f"CASE WHEN coalesce({stem}, '') <> '' AND coalesce({query}, '') <> '' AND {query} <> '{DASH}' "
            f"THEN concat({stem}, '?', {query}) ELSE {stem} END")

    def to_int(c: str, t: str) -> str:
        return f"CASE WHEN {c} <> '{DASH}' THEN try_cast({c} AS {t}) END"

    def ok(expr: str, name: str) -> str:
        return f"CASE WHEN {matched} THEN {expr} END AS `{name}`"

    d, t = v["date"], v["time"]
    dp, tp = f"split({d}, '-', -1)", f"split({t}, ':', -1)"
    parts = [f"try_cast(get({dp}, {i}) AS INT)" for i in range(3)] + [f"try_cast(get({tp}, {i}) AS INT)" for i in range(3)]
    iso = (f"CASE WHEN {d} IS NOT NULL AND {t} IS NOT NULL AND {d} NOT IN ('', '{DASH}') AND {t} NOT IN ('', '{DASH}') "
           f"AND size({dp}) = 3 AND size({tp}) = 3 AND " + " AND ".join(f"{x} IS NOT NULL" for x in parts)
           + f" THEN concat(format_string('%04d-%02d-%02dT%02d:%02d:%02d', {', '.join(parts)}), '{TZ_SUFFIX}') END")
    status = to_int(v["sc-status"], "INT")
    sev = (f"CASE WHEN {status} BETWEEN 500 AND 599 THEN 'error' WHEN {status} BETWEEN 400 AND 499 THEN 'warning' "
           f"ELSE 'info' END")
    src = f"`{source_col}`" if source_col else "'iis'"
    keep = [c for c in lines.columns if c not in EVENT_FIELDS and c != "status"]
    return step2.selectExpr(
        *[f"`{c}`" for c in keep],
        "header_line",
        f"CASE WHEN __blank OR {directive} THEN 'skip' WHEN {matched} THEN 'ok' ELSE 'error' END AS status",
        ok(iso, "timestamp"),
        f"{src} AS source",
        f"CASE WHEN {matched} THEN {sev} ELSE 'info' END AS severity",
        ok(f"nullif({v['c-ip']}, '{DASH}')", "client_ip"),
        ok(f"nullif({v['cs-method']}, '{DASH}')", "method"),
        ok(path, "path"),
        ok(status, "status_code"),
        ok(to_int(v["sc-bytes"], "BIGINT"), "bytes"),
        ok(to_int(v["time-taken"], "BIGINT"), "duration_ms"),
        "CAST(NULL AS STRING) AS backend",
        "source_file",
        "line_number",
        "raw",
    )
