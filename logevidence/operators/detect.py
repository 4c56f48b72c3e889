"""P-16/P-17: which parser reads each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import check_source

SAMPLE_LINES = 10


def name_rule(file_name) -> "F.Column":
    """The name part of P-16: ``haproxy``, ``iis`` or null (content decides)."""
    name = F.lower(file_name)
    return F.when(name.contains("haproxy"), "haproxy").when(name.contains("iis") | name.startswith("u_ex"), "iis")


def detect_sources(lines: DataFrame) -> DataFrame:
    """One row per file: ``source_path, source_file, source`` by the detection rules.

    Rules in order: name contains ``haproxy``; name contains ``iis`` or starts
    with ``u_ex``; one of the first 10 lines starts (any case) with ``#fields:``
    or ``#software``; else ``haproxy``. Only the first lines are aggregated.
    """
    key = "source_path" if "source_path" in lines.columns else "source_file"
    low = F.lower(F.col("raw"))
    directive = low.startswith("#fields:") | low.startswith("#software")
    head = (
        lines.where(F.col("line_number") <= SAMPLE_LINES)
        .groupBy(key, "source_file")
        .agg(F.bool_or(directive).alias("__w3c"))
    )
    src = F.coalesce(name_rule(F.col("source_file")), F.when(F.col("__w3c"), "iis"), F.lit("haproxy"))
    out = head.select(key, "source_file", src.alias("source"))
    if key != "source_path":
        out = out.withColumn("source_path", F.col("source_file"))
    return out


def resolve_source(forced: str | None, configured: str = "auto") -> str | None:
    """P-17: forced (not auto) > configured (not auto) > detection (None)."""
    if forced is not None:
        check_source(forced)
    check_source(configured)
    if forced and forced != "auto":
        return forced
    if configured != "auto":
        return configured
    return None
