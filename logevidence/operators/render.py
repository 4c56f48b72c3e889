"""P-26: human-readable rendering of retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.events import severities_text

# ---------------------------------------------------------------------------
# The display templates of the original command-line output.
HEADER = 'Consulta: "{query}"  ·  {n} resultado(s)'
NO_MATCH = 'Consulta: "{query}"\n(sin coincidencias)'
RULE = "-" * 60
# ---------------------------------------------------------------------------


def _py(c):
    return F.coalesce(c.cast("string"), F.lit("None"))


def render_results(results: DataFrame) -> DataFrame:
    """Add ``rendered``: ``#rank  score=S  document`` and a second line with chunk,
    line range, time range and severities (``-`` when none)."""
    line1 = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit("  score="),
                     F.format_string("%.4f", F.col("score")), F.lit("  "), _py(F.col("document")))
    line2 = F.concat(
        F.lit("     chunk="), F.col("chunk_id"), F.lit("  líneas "), _py(F.col("line_start")), F.lit("-"),
        _py(F.col("line_end")), F.lit("  ts="), _py(F.col("ts_start")), F.lit(".."), _py(F.col("ts_end")),
        F.lit("  severidades=["), severities_text(F.col("severities"), ":", ", ", "-"), F.lit("]"),
    )
    return results.withColumn("rendered", F.concat(line1, F.lit("\n"), line2))


def render_text(query: str, results: DataFrame) -> str:
    """The whole report as one string (collects the k result rows only)."""
    rows = render_results(results).orderBy("rank").select("rendered").collect()
    if not rows:
        return NO_MATCH.format(query=query)
    return "\n".join([HEADER.format(query=query, n=len(rows)), RULE, *[r[0] for r in rows]])
