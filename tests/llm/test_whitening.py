"""Whitening: the solver against dense eigenvectors, the query against numpy."""

import math

import numpy as np
import pytest

import __spark_entry__ as E
from rlframe.llm import whitening

SF = "/root/testdata/sf0.001"


def spread(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return q, (q * values) @ q.T


@pytest.mark.parametrize("values", [np.linspace(1, 2, 64), 1.1 ** -np.arange(300.0), np.r_[5, 5, 5, np.ones(80)],
                                    np.r_[9.0, np.zeros(30)], np.array([3.0]), 1e8 / np.arange(1, 121) ** 2])
def test_leading_pairs_equal_dense_ones(values):
    q, a = spread(values)
    blocks = []
    e, u, residual = whitening.leading_pairs(lambda b: blocks.append(b.shape[1]) or a @ b, len(values), 16)
    want = np.sort(values)[::-1][:16]
    assert np.allclose(e, want, rtol=0, atol=1e-12 * values.max())
    assert np.allclose(u.T @ u, np.eye(len(want)), atol=1e-12)
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-12 * values.max() and residual < 1e-12
    assert max(blocks) <= 32 or max(blocks) <= len(values)


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(5)
    _, a = spread(np.linspace(1, 9, 30), 3)
    u, _ = np.linalg.qr(rng.normal(size=(30, 4)))
    project = lambda x: x - u @ (u.T @ x)
    right, shifts = project(rng.normal(size=(30, 3))), np.array([9.5, 0.2, 5.03])
    t = whitening.minres_block(lambda b: a @ b, shifts, right, project, 60)
    assert np.allclose(project(a @ t - t * shifts), right, atol=1e-8)
    # a few steps already minimise the residual over their Krylov space
    t = whitening.minres_block(lambda b: a @ b, shifts, right, project, 3)
    for i, s in enumerate(shifts):
        op = lambda x: project(a @ x - x * s)  # noqa: E731, B023
        k = np.column_stack([right[:, i], op(right[:, i]), op(op(right[:, i]))])
        image = np.column_stack([op(c) for c in k.T])
        best = np.linalg.norm(right[:, i] - image @ np.linalg.lstsq(image, right[:, i], rcond=None)[0])
        assert np.linalg.norm(right[:, i] - op(t[:, i])) == pytest.approx(best, rel=1e-8)


def plain(rows, components=16):
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[n * a - s for a, s in zip(r, sums)] for r in fit]) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(r, sums)) for i, r in x.items()}
    white = {i: (np.array([n * a - s for a, s in zip(r, sums)]) / n) @ u / np.sqrt(e) for i, r in x.items()}
    return n, deviation, white, e / np.trace(z.T @ z / n)


def test_query_equals_dense_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, white, explained = plain(rows)
    got = {}
    for r in E.queries()["op11_jacobi_davidson_whitening"](spark, SF).collect():
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        got[r.vec_id, r.component] = r.whitened
    assert len(got) == 16 * len(rows)
    for k in range(16):
        a, b = np.array([got[i, k + 1] for i, _ in rows]), np.array([white[i][k] for i, _ in rows])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -2.0], 9), (2, [0.5, 1.0, -2.0], 9), (2, [3.0, -1.0, 0.25], 9), (None, [1.0, 1.0, 1.0], 9), (4, None, 9),
            (5, [1.0, None, 2.0], 9), (6, [1.0, nan, 2.0], 9), (7, [1.0, inf, 2.0], 9), (8, [1.0], 9), (9, [], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")
    got = whitening.whitened_vectors(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in got} == {3} and max(r.identity_error for r in got) < 1e-9
    for none in (df.filter("false"), df.filter("vec_id = 1"), df.filter("vec_id = 9"), df.filter("vec_id in (4, 5, 6, 7)")):
        assert whitening.whitened_vectors(none).count() == 0
    with pytest.raises(OverflowError):
        whitening._exact_squares(np.array([[2 ** 33, 1]]))
    assert whitening._exact_squares(np.array([[2 ** 31, 2 ** 30, -3]])).tolist() == [2 ** 62 + 2 ** 60 + 9]
