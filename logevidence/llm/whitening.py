"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers, so counts, sums, deviations and the scatter are
exact at any partitioning. The centred scatter is factored with pivoting, V =
L L'. Jacobi rotations from the right make the columns of L orthogonal: their
squared norms are V's eigenvalues, the normalised columns its eigenvectors.
Neither V's square nor L L' is formed again, which keeps small eigenvalues
accurate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from logevidence.llm.common import written

MAX_COMPONENTS = 32
# An entry c counts as floor(SCALE * c) + OFFSET.
SCALE = 64
OFFSET = 1_000_000
# Whole numbers below this are exact as doubles, and so are their sums.
EXACT = 1 << 53
MAX_SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """``centre`` + ``rest`` / ``n`` is the mean (centre the nearest integer); components are columns, by falling eigenvalue."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """-> the rows that have a usable vector, and their whole-number vectors (rows x dimensions).

    Null and empty vectors and those with a null, NaN or infinite entry are
    left out. Vectors of different lengths, and entries whose whole number is
    no long, are errors.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), lengths)
    usable = lengths > 0
    usable[owner[~np.isfinite(entries)]] = False
    dims = np.unique(lengths[usable])
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths: {dims[:5].tolist()}")
    scaled = np.floor(entries[usable[owner]] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 1 << 62:
        raise OverflowError("an entry is beyond the range of a long")
    return np.flatnonzero(usable), scaled.astype(np.int64).reshape(int(usable.sum()), dims[0] if len(dims) else 0) + OFFSET


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of usable vectors, and the sum of each dimension."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            _, x = whole_vectors(batch.column("embedding"))
            if len(x):
                if total is not None and len(total) != x.shape[1]:
                    raise ValueError(f"vectors of different lengths: {[len(total), x.shape[1]]}")
                high, low = x >> 31, x & (1 << 31) - 1  # sums of either fit a long
                here = [(int(h) << 31) + int(w) for h, w in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
                total = here if total is None else [a + b for a, b in zip(total, here, strict=True)]
                n += len(x)
        if n:
            size = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(map(str, total), pa.string())],
                names=["size", "at", "n", "total"],
            )

    part = vectors.mapInArrow(added, "size int, at int, n long, total string")
    rows = part.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).orderBy("at").collect()
    if len({r["size"] for r in rows}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({r['size'] for r in rows})[:5]}")
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def exact_products(x: np.ndarray) -> np.ndarray:
    """x'x of whole numbers, as Python integers."""
    most = int(np.abs(x).max(initial=1))
    if most * most * 4 > EXACT:
        wide = x.astype(object)
        return wide.T @ wide
    step = EXACT // (most * most)
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for start in range(0, len(x), step):
        part = x[start : start + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _scatter(vectors: DataFrame, centre: np.ndarray) -> list[list[int]]:
    """Sums of products of the vectors less ``centre``, exact; a task sends one sum a pair of dimensions."""
    size = len(centre)
    rows, cols = np.triu_indices(size)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = whole_vectors(batch.column("embedding"))
            if len(x):
                here = exact_products(x - centre)
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array([str(total[i, j]) for i, j in zip(rows, cols, strict=True)], pa.string())], names=["i", "j", "total"]
            )

    sums = vectors.mapInArrow(added, "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    out = [[0] * size for _ in range(size)]
    for r in sums.collect():
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["total"])
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', as many columns as ``a`` has rank; its rows in the order of the pivots are lower triangular."""
    size = len(a)
    factor, rest = np.zeros((size, size)), a.diagonal().copy()
    open_rows = np.ones(size, dtype=bool)
    least = size * np.finfo(float).eps * rest.max(initial=0.0)
    for k in range(size):
        pivot = int(np.where(open_rows, rest, -np.inf).argmax())
        if rest[pivot] <= least:
            return factor[:, :k]
        column = (a[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(rest[pivot])
        column[~open_rows] = 0.0
        column[pivot] = np.sqrt(rest[pivot])
        factor[:, k] = column
        rest -= column**2
        open_rows[pivot] = False
    return factor


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal.

    A round rotates disjoint pairs of columns at once; each pair meets once a sweep.
    """
    g = factor.copy()
    m = g.shape[1]
    ring = list(range(m + m % 2))
    close = np.finfo(float).eps * np.sqrt(len(g))
    for _ in range(MAX_SWEEPS):
        most = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(p, q) for p, q in zip(ring[:half], reversed(ring[half:]), strict=True) if p < m and q < m]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            left, right = (np.array(side) for side in zip(*pairs, strict=True))
            x, y = g[:, left], g[:, right]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            angle = np.abs(c) / np.maximum(np.sqrt(a * b), np.finfo(float).tiny)
            most = max(most, float(angle.max()))
            turn = np.flatnonzero(angle > close)
            if len(turn):
                zeta = (b[turn] - a[turn]) / (2 * c[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                g[:, left[turn]], g[:, right[turn]] = cos * x[:, turn] - sin * y[:, turn], sin * x[:, turn] + cos * y[:, turn]
        if most <= close:
            break
    return g


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance above zero, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    rotated = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.sqrt((rotated**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    unit = rotated[:, order] / norms[order]
    if unit.size:
        unit = unit * np.sign(unit[np.abs(unit).argmax(axis=0), np.arange(unit.shape[1])])
    return norms[order] ** 2, unit


def fit(embeddings: DataFrame, max_components: int = MAX_COMPONENTS) -> Whitening:
    """Mean, components and eigenvalues of all usable vectors of ``embeddings`` (embedding array).

    Two passes: exact sums, then the scatter, centred before multiplying by the
    integer nearest to the mean; what is left of the mean (a half at most) comes
    off exactly. The driver gets dimensions x dimensions sums. A covariance of
    rank r has r components; none with less than two different vectors, or none
    usable.
    """
    vectors = embeddings.select("embedding")
    n, sums = _sums(vectors)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], dtype=object)
    size = len(sums)
    v = np.zeros((size, size))
    trace = Fraction(0)
    if n:
        scatter = _scatter(vectors, centre)
        exact = [[Fraction(n * scatter[i][j] - rest[i] * rest[j], n * n) for j in range(size)] for i in range(size)]
        trace = sum((exact[i][i] for i in range(size)), Fraction(0))
        v = np.array([[float(c) for c in row] for row in exact]).reshape(size, size)
    eigenvalues, components = principal(v)
    return Whitening(n, centre, rest, components[:, :max_components], eigenvalues[:max_components], float(trace))


def _deviations(z: np.ndarray, model: Whitening) -> pa.Array:
    """Sum of (n x - S)^2 over the dimensions, exact: z is x less the centre."""
    most = model.n * int(np.abs(z).max(initial=0)) + max(map(abs, model.rest), default=0)
    if most * most * max(1, z.shape[1]) < 1 << 63:
        d = model.n * z - model.rest.astype(np.int64)
        return pa.array((d * d).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    d = model.n * z.astype(object) - model.rest
    return pa.array([Decimal(int(s)) for s in (d * d).sum(axis=1)], pa.decimal128(38, 0))


def whiten(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """``embeddings`` (vec_id, embedding, ...) -> (vec_id, deviation decimal(38,0), whitened array<double>), a row per usable vector.

    Rows with unusable vectors (see ``whole_vectors``) are left out; repeated
    rows and null vec_ids stay. Other columns aren't returned.
    """
    shift = model.rest.astype(np.float64) / max(1, model.n)
    project = model.components / np.sqrt(model.eigenvalues)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_vectors(batch.column("embedding"))
            if not len(at):
                continue
            z = x - model.centre
            w = (z - shift) @ project
            offsets = pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)), _deviations(z, model), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))],
                names=["vec_id", "deviation", "whitened"],
            )

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return embeddings.select("vec_id", "embedding").mapInArrow(projected, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry of the covariance of all rows' ``whitened`` less the identity; 0.0 without rows or components."""
    means = [r["mean"] for r in whitened.select(F.posexplode("whitened").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("mean")).orderBy("at").collect()]
    if not means:
        return 0.0
    mean, size = np.array(means), len(means)
    rows, cols = np.triu_indices(size)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy().reshape(-1, size) - mean
            total += w.T @ w
            n += len(w)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols]), pa.array([n] * len(rows), pa.int64())], names=["i", "j", "total", "n"])

    sums = whitened.select("whitened").mapInArrow(added, "i int, j int, total double, n long").groupBy("i", "j").agg((F.sum("total") / F.sum("n")).alias("v"))
    return float(sums.agg(F.max(F.abs(F.col("v") - (F.col("i") == F.col("j")).cast("double"))).alias("most")).first()["most"])


def whitening_digest(embeddings: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    ``deviation`` is a long here, and an error where it doesn't fit one. An
    empty table, or one without a component, gives an empty result.
    """
    model = fit(embeddings)
    rows = written(whiten(embeddings, model), "whitened")
    error = identity_error(rows)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)).cast("array<double>")
    return rows.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
