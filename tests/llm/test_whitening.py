"""Whitening against numpy's eigenvectors, and on odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import common, whitening
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, dim int, `a.b` int"


def grid(v) -> list[int]:
    return [math.floor(256 * float(c)) for c in v]


def check(rows, got, most=4):
    """``rows``: (vec_id, vector) of one length; every figure against exact or numpy results."""
    sound = [(i, grid(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=np.int64)
    n, s = len(fit), [int(t) for t in fit.sum(0)]
    centred = fit - np.array(s) / n
    values, units = np.linalg.eigh(centred.T @ centred / n)
    values, units = values[::-1], units[:, ::-1]
    rank = min(most, int((values > values[0] * len(s) * 2.0**-52).sum()))
    assert len(got) == rank * len(sound)
    want = {}
    for i, x in sound:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for k in range(rank):
            w = float((np.array(x) - np.array(s) / n) @ units[:, k] / math.sqrt(values[k]))
            want.setdefault((i, k + 1), []).append((dev, w))
    signs = {}
    for r in got:
        choices = want[r.vec_id, r.component]
        assert r.n == n and r.deviation in {d for d, _ in choices}
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
        near = min((w for _, w in choices), key=lambda w: abs(abs(w) - abs(r.whitened)))
        assert abs(r.whitened) == pytest.approx(abs(near), abs=1e-6)
        if abs(near) > 1e-3 and len(choices) == 1:
            signs.setdefault(r.component, set()).add(math.copysign(1, near * r.whitened))
    assert all(len(s) == 1 for s in signs.values())


def test_embeddings(spark):
    rows = common.table(spark, SF, "embeddings")
    check([(r.vec_id, r.embedding) for r in rows.collect()], whitening.whiten(rows).collect())


def frame(spark, rows):
    common.prepare(spark)
    floats = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in floats], SCHEMA)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * [1, 5, 2, 1, 0.1, 3]]) for i in range(60)]
    rows += [(70, rows[0][1]), (70, rows[0][1]), (None, rows[1][1]), (71, [c + 1e-4 for c in grid(rows[2][1])])]
    rows[-1] = (71, [c / 256 + 1e-4 for c in grid(rows[2][1])])  # another vector with the same grid
    odd = [(80, None), (81, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (82, [float("nan")] * 6), (83, [1.0, float("-inf"), 0, 0, 0, 0])]
    check(rows, whitening.whiten(frame(spark, [*rows, *odd, (84, []), (85, [1.0, 2.0])])).collect())


def test_a_vector_held_by_most_rows_counts_once(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(1000 + i, [float(i), float(i * i % 7), 1.0]) for i in range(40)]
    check(rows, whitening.whiten(frame(spark, rows)).collect())


def test_tables_without_spread(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert {(r.vec_id, r.component, r.explained) for r in one} == {(1, 1, 1.0), (2, 1, 1.0)}
    assert sorted(r.whitened for r in one) == [-1.0, 1.0]


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e6 + i, -1e6 + (i * i) % 11]) for i in range(30)]
    check(rows, whitening.whiten(frame(spark, rows)).collect())
    far = whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.deviation for r in far} == {None} | {r.deviation for r in far if r.vec_id == 3}


def test_cholesky_and_jacobi():
    """The factor gives the matrix back, and the rotated columns its eigenpairs, small ones to full relative accuracy."""
    rng = np.random.default_rng(1)
    for size, rank in ((1, 1), (2, 2), (7, 7), (32, 32), (33, 20)):
        a = rng.normal(size=(size, rank)) * 10.0 ** -rng.integers(0, 6, size=rank)
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v[order][:, order], rtol=1e-10, atol=1e-13 * v.max())
        assert (np.triu(factor, 1) == 0).all()
        rotated = whitening.one_sided_jacobi(factor)
        gram = rotated.T @ rotated
        norms = np.sqrt(gram.diagonal())
        assert np.abs(gram / np.outer(norms, norms) - np.eye(len(norms))).max() < 1e-13
        true = np.linalg.eigvalsh(v)[::-1][: len(norms)]
        assert np.allclose(np.sort(norms**2)[::-1], true, rtol=1e-8, atol=1e-13 * v.max())
    scale = np.diag([1.0, 1e-2, 1e-4])
    graded = scale @ np.array([[2, 1, 1], [1, 3, 1], [1, 1, 4.0]]) @ scale
    rotated = whitening.one_sided_jacobi(whitening.pivoted_cholesky(graded)[0])
    product = float(np.prod((rotated * rotated).sum(0)))
    assert product == pytest.approx(17e-12, rel=1e-9, abs=0)  # the determinant: no small eigenvalue is lost


def test_every_pair_meets_once_in_a_sweep():
    for size in (2, 3, 8, 9):
        met = [tuple(sorted(p)) for a, b in whitening.rounds_of(size) for p in zip(a.tolist(), b.tolist())]
        assert sorted(met) == [(i, j) for i in range(size) for j in range(i + 1, size)]


def test_grid_values(spark):
    got = spark.range(1).select(whitening.on_grid(F.array(F.lit(-0.0), F.lit(0.999), F.lit(-0.001))).alias("x")).first().x
    assert got == [0, 255, -1]
