"""E-01 core: lines -> classified lines -> events and parse statistics.

F-01 three-way status, F-02 error policy, P-15 placeholder events, A-01/A-02
per-file and grand-total statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_IIS_FIELDS, check_policy
from ..schemas import EVENT_FIELDS
from .detect import detect_sources, resolve_source
from .haproxy import haproxy_events
from .iis import iis_events


def _haproxy(lines: DataFrame, **_) -> DataFrame:
    return haproxy_events(lines, "source")


def _iis(lines: DataFrame, iis_fields=DEFAULT_IIS_FIELDS, iis_fields_from_header=True) -> DataFrame:
    return iis_events(lines, iis_fields, iis_fields_from_header, "source")


# X-03: one DataFrame function per log source. A new source registers a function
# ``lines (with a 'source' column) -> lines + status + the 13 event columns``.
PARSERS = {"haproxy": _haproxy, "iis": _iis}


# Files whose detected kinds (a path and a kind each) are broadcast; those of more are joined.
MAX_BROADCAST_FILES = 50_000


class ParseError(Exception):
    """Raised under ``on_parse_error='fail'``, naming file, line and raw text."""


def classify_lines(
    lines: DataFrame,
    *,
    forced_source: str | None = None,
    source_type: str = "auto",
    iis_fields: Sequence[str] = DEFAULT_IIS_FIELDS,
    iis_fields_from_header: bool = True,
) -> DataFrame:
    """Every input line with ``source``, ``status`` and the event columns.

    Where the source is to be detected, the files' first lines are read first:
    of one kind only, the lines go straight to its parser, without a join.
    """
    if "source_path" not in lines.columns:
        lines = lines.withColumn("source_path", F.col("source_file"))
    fixed = resolve_source(forced_source, source_type)
    opts = {"iis_fields": iis_fields, "iis_fields_from_header": iis_fields_from_header}
    if fixed is not None:
        return PARSERS[fixed](lines.withColumn("source", F.lit(fixed)), **opts)
    det = detect_sources(lines).select("source_path", "source")
    kinds = {r["source"]: r["count"] for r in det.groupBy("source").count().collect()}  # two at most
    if len(kinds) < 2:
        kind = next(iter(kinds), "haproxy")
        return PARSERS[kind](lines.withColumn("source", F.lit(kind)), **opts)
    # One row per file: broadcast up to a number of files, so that the lines are not shuffled for it.
    if sum(kinds.values()) <= MAX_BROADCAST_FILES:
        det = F.broadcast(det)
    tagged = lines.drop("source").join(det, on="source_path", how="inner")
    hap_lines = tagged.where(F.col("source") == "haproxy")
    iis_lines = tagged.where(F.col("source") == "iis")
    return PARSERS["haproxy"](hap_lines, **opts).unionByName(PARSERS["iis"](iis_lines, **opts))


def first_error(classified: DataFrame):
    """The first unparseable line in (path, line) order, or None."""
    row = (
        classified.where(F.col("status") == "error")
        .agg(F.min(F.struct("source_path", "line_number", "source_file", "raw")).alias("m"))
        .first()
    )
    return None if row is None or row["m"] is None else row["m"]


# What the error of a stopped write begins with.
STOPPED = "unparseable line met in "


def stop_at_errors(classified: DataFrame) -> DataFrame:
    """F-02 ``fail``: the same rows, whose evaluation fails at an unparseable line.

    A write of them is given up by the first task that meets one, and nothing
    of it is committed; clean lines need no pass of their own.
    """
    place = F.concat(F.lit(STOPPED), F.col("source_file"), F.lit(":"), F.col("line_number").cast("string"))
    return classified.withColumn("status", F.when(F.col("status") == "error", F.raise_error(place)).otherwise(F.col("status")))


def error_of(bad) -> ParseError:
    return ParseError(f"unparseable line in {bad['source_file']}:{bad['line_number']} -> {bad['raw']!r}")


def line_counts() -> list:
    """A-02 as aggregates of classified lines, for ``DataFrame.observe`` on the pass that writes them."""
    of = lambda s: F.count_if(F.col("status") == s)
    return [F.count(F.lit(1)).alias("lines"), of("ok").alias("ok"), of("error").alias("errors")]


def totals_of(seen: dict, on_parse_error: str) -> dict:
    """The grand total of ``parse_stats`` from observed line counts (without the number of files)."""
    skipped = seen["errors"] if on_parse_error == "skip" else 0
    kept = seen["errors"] if on_parse_error == "keep" else 0
    return {"lines": seen["lines"], "ok": seen["ok"], "skipped_errors": skipped, "kept_errors": kept, "events": seen["ok"] + kept}


def events_of(classified: DataFrame, on_parse_error: str = "skip", keep_path: bool = True) -> DataFrame:
    """F-02: ``skip`` drops unparseable lines, ``keep`` keeps them as P-15
    placeholders at their position, ``fail`` raises on the first one."""
    check_policy(on_parse_error)
    if on_parse_error == "fail":
        bad = first_error(classified)
        if bad is not None:
            raise error_of(bad)
    wanted = ["ok", "error"] if on_parse_error == "keep" else ["ok"]
    cols = (["source_path"] if keep_path else []) + list(EVENT_FIELDS)
    return classified.where(F.col("status").isin(*wanted)).select(*cols)


def parse_stats(classified: DataFrame, on_parse_error: str = "skip") -> DataFrame:
    """A-01 per file and A-02 grand total (``is_total`` row) in one grouping-sets pass."""
    check_policy(on_parse_error)
    st = F.col("status")
    err = F.count_if(st == "error")
    zero = F.lit(0).cast("long")
    per_file = classified.groupBy("source_path", "source_file", "source").agg(
        F.lit(1).cast("long").alias("files"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(st == "ok").alias("ok"),
        (err if on_parse_error == "skip" else zero).alias("skipped_errors"),
        (err if on_parse_error == "keep" else zero).alias("kept_errors"),
    )
    nums = ["files", "lines", "ok", "skipped_errors", "kept_errors"]
    # The total is folded from the per-file rows (one row per file), not from the lines.
    total = per_file.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in nums]).select(
        F.lit(None).cast("string").alias("source_path"),
        F.lit(None).cast("string").alias("source_file"),
        F.lit(None).cast("string").alias("source"),
        *nums,
    )
    both = per_file.withColumn("is_total", F.lit(False)).unionByName(total.withColumn("is_total", F.lit(True)))
    return both.select(
        "source_path", "source_file", "source", *nums,
        (F.col("ok") + F.col("kept_errors")).alias("events"), "is_total",
    )
