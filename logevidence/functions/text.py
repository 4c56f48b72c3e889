"""String helpers with the original tool's (Python) text semantics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The characters Python treats as whitespace (str.split/strip)
# and as line boundaries (str.splitlines), written as Java regex classes.
WS_CLASS = (
    "[\\t\\n\\x{0B}\\x{0C}\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}"
    "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
LINE_BREAK = "\\r\\n|[\\n\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"
# The boundaries inside of a row that ends at a line feed.
LINE_BREAK_IN_ROW = "[\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"
# ---------------------------------------------------------------------------


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """``str.strip()``: trim Python whitespace from both ends."""
    return F.regexp_replace(col_(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def is_blank(c: str | Column) -> Column:
    """``not s.strip()``: empty or whitespace only."""
    return col_(c).rlike(f"^{WS_CLASS}*$")


def split_ws(c: str | Column) -> Column:
    """``str.split()`` with no argument: whitespace runs, no empty tokens."""
    return F.split(strip_ws(c), f"{WS_CLASS}+")


def split_ws_nonempty(c: str | Column) -> Column:
    """Like :func:`split_ws` but an all-blank string gives ``[]`` (not ``[""]``)."""
    s = strip_ws(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS_CLASS}+"))


def split_lines(c: str | Column) -> Column:
    """``str.splitlines()``: split on every Python line boundary, drop the final empty piece."""
    parts = F.split(col_(c), LINE_BREAK, -1)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ).otherwise(parts)


def path_stem(c: str | Column) -> Column:
    """``Path(name).stem``: drop the last suffix, keep a leading dot."""
    return F.regexp_replace(col_(c), "(?<=.)\\.[^.]*$", "")


def base_name(c: str | Column) -> Column:
    """Last path component of a path or URI."""
    return F.regexp_extract(col_(c), "([^/]*)$", 1)
