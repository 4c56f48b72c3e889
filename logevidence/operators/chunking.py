"""E-02 core: overlapping count windows of events (W-01..W-03, A-03..A-11, P-18, F-09).

Windows are computed in closed form, not by a loop: with step = size - overlap,
event position p (0-based) of a file with n events belongs to chunks
``lo..hi`` where ``lo = max(0, floor((p - size) / step) + 1)``,
``hi = min(floor(p / step), last)`` and ``last = 0 if n <= size else
ceil((n - size) / step)``. Each event is replicated at most ceil(size / step)
times and one ``groupBy(file, chunk)`` builds every chunk column; the window
arrays hold at most ``chunk_size`` elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import check_chunking
from ..functions.events import render_event_line
from ..functions.text import base_name, path_stem
from ..schemas import CHUNK_FIELDS
from .ordinal import ordinal_within


def chunk_window_bounds(p: Column, n: Column, size: int, overlap: int) -> tuple[Column, Column]:
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)))
    lo = F.greatest(F.lit(0), F.floor((p - size) / F.lit(step)) + 1)
    hi = F.least(F.floor(p / F.lit(step)), last)
    return lo.cast("long"), hi.cast("long")


def positioned_events(events: DataFrame, key: str | None = None) -> DataFrame:
    """W-02: add ``pos`` (0-based event position in its file) and ``n_file``."""
    key = key or ("source_path" if "source_path" in events.columns else "source_file")
    return ordinal_within(events, [key], "line_number", out="pos", total="n_file")


def explode_to_chunks(pos_events: DataFrame, chunk_size: int, chunk_overlap: int) -> DataFrame:
    """Replicate each positioned event into every window that contains it (column ``chunk_index``)."""
    check_chunking(chunk_size, chunk_overlap)
    lo, hi = chunk_window_bounds(F.col("pos"), F.col("n_file"), chunk_size, chunk_overlap)
    rng = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))
    return pos_events.withColumn("chunk_index", F.explode(rng))


def stem_collisions(events: DataFrame, key: str = "source_path") -> DataFrame:
    """Stems shared by several files (their ``<stem>-<i>`` chunk ids would collide)."""
    stem = path_stem(base_name(F.col(key)))
    return (events.select(stem.alias("stem"), F.col(key).alias("path")).distinct()
            .groupBy("stem").agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1"))


def chunk_events(
    events: DataFrame,
    chunk_size: int = 20,
    chunk_overlap: int = 4,
    key: str | None = None,
    stem: Column | None = None,
    id_scope: str = "stem",
) -> DataFrame:
    """Chunks in the CHUNK layout plus ``source_path``, ``chunk_index`` and ``backends``.

    ``chunk_id`` is ``<stem>-<index>``, stem = the file name without its last
    suffix; ``id_scope='path'`` uses the whole path instead (no collisions when
    equal names live in different folders, see :func:`stem_collisions`).
    """
    if id_scope not in ("stem", "path"):
        raise ValueError("id_scope must be 'stem' or 'path'")
    check_chunking(chunk_size, chunk_overlap)
    key = key or ("source_path" if "source_path" in events.columns else "source_file")
    ev = events.withColumn("__line", render_event_line())
    pos = positioned_events(ev, key)
    exploded = explode_to_chunks(pos, chunk_size, chunk_overlap)
    g = exploded.groupBy(key, "chunk_index").agg(
        F.expr("array_sort(collect_list(named_struct('p', pos, 'line', line_number, "
               "'sev', coalesce(severity, 'info'), 'txt', __line)))").alias("__items"),
        F.expr("min(nullif(timestamp, ''))").alias("ts_start"),
        F.expr("max(nullif(timestamp, ''))").alias("ts_end"),
        F.expr("CAST(count(1) AS INT)").alias("n_events"),
        F.expr("array_sort(collect_set(nullif(source, '')))").alias("sources"),
        F.expr("array_sort(collect_set(nullif(source_file, '')))").alias("__files"),
        F.expr("array_sort(collect_set(backend))").alias("backends"),
    )
    if stem is not None:
        file_stem = stem
    elif id_scope == "path":
        file_stem = F.regexp_replace(F.col(key), "(?<=[^/])\\.[^./]*$", "")
    else:
        file_stem = path_stem(base_name(F.col(key)))
    # Everything below works on arrays of at most chunk_size elements.
    lines = "filter(transform(__items, s -> s.line), x -> x IS NOT NULL)"
    sevs = "transform(__items, s -> s.sev)"
    out = g.select(
        F.concat(file_stem, F.lit("-"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.expr("array_join(__files, ',')").alias("source_file"),
        "sources",
        F.expr(f"get({lines}, 0)").alias("line_start"),
        F.expr(f"try_element_at(reverse({lines}), 1)").alias("line_end"),
        "ts_start",
        "ts_end",
        "n_events",
        F.expr(f"map_from_arrays(array_distinct({sevs}), transform(array_distinct({sevs}), "
               f"k -> CAST(size(filter({sevs}, x -> x = k)) AS INT)))").alias("severities"),
        F.expr(lines).alias("event_lines"),
        F.expr("array_join(transform(__items, s -> s.txt), '\\n')").alias("text"),
        F.col(key).alias("source_path") if key != "source_path" else F.col("source_path"),
        "chunk_index",
        "backends",
    )
    return out.select(*CHUNK_FIELDS, "source_path", "chunk_index", "backends")
