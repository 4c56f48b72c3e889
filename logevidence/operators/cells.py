"""T-01 approximate search: points in cells around centres, few of which a query reads.

The centres are fitted on a bounded sample; every point goes to the cell of
its nearest centre, and the table is partitioned by cell, so that a query's
cells are a partition filter of the scan. The number of cells to read is
measured: so many that sampled queries find the wanted share of their true
neighbours. ``retrieval.search`` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import check_metric, check_top_k
from .retrieval import search

# Vectors that centres and the number of cells to read are fitted on.
SAMPLE = 20_000
SAMPLED_QUERIES = 200
ROUNDS = 12


@dataclass(frozen=True)
class Cells:
    """``centres`` has a row per cell; a query reads its ``probes`` nearest."""

    metric: str
    centres: np.ndarray
    probes: int
    recall: float


def _comparable(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose nearest centres are to be found: of length 1 for the cosine."""
    if metric != "cosine":
        return vectors
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), np.finfo(float).tiny)


def _far(vectors: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """What is less for the nearer centre."""
    products = vectors @ centres.T
    return -products if metric == "ip" else (centres * centres).sum(axis=1) - 2 * products


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each vector: always by distance, also where inner products count."""
    return _far(vectors, centres, "l2").argmin(axis=1)


def _fitted(vectors: np.ndarray, cells: int) -> np.ndarray:
    rng = np.random.default_rng(0)
    centres = vectors[np.sort(rng.choice(len(vectors), cells, replace=False))]
    for _ in range(ROUNDS):
        cell = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        n = np.bincount(cell, minlength=cells)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def fit_cells(points: DataFrame, cells: int = 64, *, metric: str = "cosine", top_k: int = 10, recall: float = 0.95) -> Cells:
    """Centres and the cells to read, from at most about SAMPLE points drawn by a hash of the id.

    ``recall`` is the share of the sample's true ``top_k`` neighbours that
    SAMPLED_QUERIES of its points are to find; the least number of cells that
    does is kept. Points without a vector don't count; without any there is one
    cell.
    """
    check_metric(metric)
    check_top_k(top_k)
    usable = points.where("embedding is not null and size(embedding) > 0").select("id", "embedding")
    n = usable.count()
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1 << 30)) < share).orderBy(F.xxhash64("id")).select("embedding").toArrow()
    if not drawn.num_rows:
        return Cells(metric, np.zeros((1, 1)), 1, 1.0)
    vectors = _comparable(np.stack(drawn.column("embedding").to_numpy()).astype(float), metric)
    centres = _fitted(vectors, min(cells, len(vectors)))
    cell, queries = _nearest(vectors, centres), vectors[:SAMPLED_QUERIES]
    order = _far(queries, centres, metric).argsort(axis=1)
    rank = order.argsort(axis=1)  # of each cell, for each query
    true = _far(queries, vectors, metric).argpartition(min(top_k, len(vectors)) - 1, axis=1)[:, :top_k]
    ranks = np.sort(np.take_along_axis(rank, cell[true], axis=1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
    return Cells(metric, centres, probes, float((ranks < probes).mean()))


def write_cells(points: DataFrame, cells: Cells, path: str) -> None:
    """All ``points``, partitioned by cell; those without a vector of the centres' length are in cell -1.

    A large cell is many files: rows are dealt by cell and a hash of the id, in ranges.
    """
    centres, metric = cells.centres, cells.metric

    @F.arrow_udf("int")
    def cell_of(column: pa.Array) -> pa.Array:
        out = np.full(len(column), -1, dtype=np.int32)
        lengths = np.array([len(v) if v.is_valid else -1 for v in column])
        at = np.flatnonzero(lengths == centres.shape[1])
        if len(at):
            vectors = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
            out[at] = _nearest(_comparable(vectors, metric), centres)
        return pa.array(out)

    dealt = points.withColumn("cell", cell_of("embedding"))
    dealt.repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").parquet(path)


def search_cells(table: DataFrame, cells: Cells, vector: Sequence[float], top_k: int = 5, where: Column | None = None,
                 probes: int | None = None) -> DataFrame:
    """The ``top_k`` nearest points of the query's nearest cells, as ``retrieval.search`` returns them.

    ``table`` is what write_cells() wrote. Only those cells' partitions are
    read; with all cells the result is exact. Fewer than ``top_k`` rows come
    back where the cells read hold no more.
    """
    query = _comparable(np.array([vector], dtype=float), cells.metric)
    near = np.arange(1) if query.shape[1] != cells.centres.shape[1] else _far(query, cells.centres, cells.metric)[0].argsort(kind="stable")
    chosen = [int(c) for c in near[: cells.probes if probes is None else probes]]
    return search(table.where(F.col("cell").isin(chosen)).drop("cell"), vector, top_k=top_k, metric=cells.metric, where=where)


__all__ = ["Cells", "fit_cells", "write_cells", "search_cells"]
