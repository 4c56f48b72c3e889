"""Column-expression helpers (JVM-side, codegen friendly)."""

from .events import (  # noqa: F401
    citation,
    haproxy_iso_parts,
    iis_iso,
    render_event_line,
    severities_text,
    severity_counts_map,
    severity_of,
)
from .text import base_name, is_blank, path_stem, split_lines, split_ws, strip_ws  # noqa: F401
from .vectors import distance, order_key, score_of, token_buckets  # noqa: F401
