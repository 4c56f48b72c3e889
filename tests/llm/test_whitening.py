import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from logevidence.llm import whitening as wh

COLUMNS = "vec_id long, embedding array<float>"


def brute(rows, most=32):
    """rows (vec_id, vector) -> n, {id: [deviation]}, eigenvalues, eigenvectors, trace; sums and scatter as fractions."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    sums = [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept]
    mean = [Fraction(s, n) for s in sums]
    centred = [[a - m for a, m in zip(x, mean, strict=True)] for _, x in kept]
    v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(len(sums))] for i in range(len(sums))])
    values, vectors = np.linalg.eigh(v)
    return n, kept, centred, deviation, values[::-1][:most], vectors[:, ::-1][:, :most], float(np.trace(v))


def check(frame):
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    n, kept, centred, deviation, values, vectors, trace = brute(rows)
    got = wh.whitening_digest(frame).collect()
    rank = int((values > 1e-9 * max(values[0], 1e-300)).sum())
    assert len(got) == n * rank
    assert {r.n for r in got} <= {n}
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(deviation) * (rank > 0)
    assert all(abs(r.explained - values[r.component - 1] / trace) <= 1e-10 * r.explained for r in got)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-8 for r in got)
    white = np.array([[float(c) for c in row] for row in centred]) @ vectors[:, :rank] / np.sqrt(values[:rank])
    apart = np.ones(rank, dtype=bool)  # eigenvectors of close eigenvalues may be turned
    for k in range(rank):
        apart[k] = all(abs(values[k] - values[j]) > 1e-6 * values[0] for j in range(len(values)) if j != k)
    for k in np.flatnonzero(apart):
        mine = sorted((r.vec_id, r.whitened) for r in got if r.component == k + 1)
        theirs = [sorted(zip([i for i, _ in kept], sign * white[:, k], strict=True)) for sign in (1, -1)]
        assert any(np.allclose([w for _, w in mine], [w for _, w in t], atol=1e-6) for t in theirs)
    return got


def test_small_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = check(frame)
    assert {r.component for r in got} == set(range(1, 33))


def test_unusable_rows_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (2, None), (3, [0.1, None, 0.2]), (4, [nan, 0.0, 0.0]), (5, [0.0, inf, 0.0]), (6, []), (7, [0.75, 0.125, -1.0]), (8, [0.0, 0.3, 0.2]), (9, [-0.5, 0.4, 0.9])]
    frame = spark.createDataFrame(rows, COLUMNS)
    assert {r.vec_id for r in check(frame)} == {1, 7, 8, 9}
    named = spark.createDataFrame([(i, v, 1, 2.0, 3, 4, "x") for i, v in rows], COLUMNS + ", n int, whitened double, component int, size int, deviation string")
    assert sorted(map(tuple, wh.whitening_digest(named).collect())) == sorted(map(tuple, wh.whitening_digest(frame).collect()))
    keyless = spark.createDataFrame([(None, v) for _, v in rows], COLUMNS)
    assert {r.vec_id for r in wh.whitening_digest(keyless).collect()} == {None}


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert wh.whitening_digest(spark.createDataFrame(rows, COLUMNS)).count() == 0


def test_rank_deficient(spark):
    rng = np.random.default_rng(1)
    whole = rng.integers(-90, 90, (50, 2)) @ rng.integers(-3, 4, (2, 6))
    frame = spark.createDataFrame([(i, [float(c) / 64 for c in row]) for i, row in enumerate(whole)], COLUMNS)
    assert {r.component for r in check(frame)} == {1, 2}


def test_lengths_must_agree(spark):
    for parts in (1, 4):
        frame = spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0]), (3, [0.1]), (4, [0.2])], COLUMNS).repartition(parts)
        with pytest.raises(Exception, match="different lengths"):
            wh.whitening_digest(frame)


def test_eigenpairs_of_graded_matrices():
    """Small eigenvalues keep their relative accuracy; vectors are orthonormal to double precision."""
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 64):
        b = rng.normal(size=(size, size)) * np.logspace(0, -4, size)
        v = b @ b.T
        values, vectors = wh.principal(v)
        assert len(values) == size and (np.diff(values) <= 0).all()
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13
        assert np.abs(vectors * values @ vectors.T - v).max() < 1e-13 * np.abs(v).max()


def test_sums_are_exact_at_any_size():
    x = np.array([[3, -(1 << 40)], [1 << 41, 5], [-7, 11]])
    wide = x.astype(object)
    assert (wh.exact_products(x) == wide.T @ wide).all()
    small = np.random.default_rng(3).integers(-(1 << 20), 1 << 20, (5_000, 4))
    assert (wh.exact_products(small) == small.astype(object).T @ small.astype(object)).all()
    model = wh.Whitening(1 << 40, np.array([5, 5]), np.array([3, -4], dtype=object), np.zeros((2, 0)), np.zeros(0), 0.0)
    z = np.array([[1 << 20, 7]])
    assert wh._deviations(z, model).to_pylist() == [((1 << 60) - 3) ** 2 + (7 * (1 << 40) + 4) ** 2]
    with pytest.raises(OverflowError):
        wh.whole_vectors(pa.array([[1e30]]))
