"""Active sets against all subsets, and deleted blocks against solving each anew from the rows."""

from itertools import combinations

import numpy as np

from strandloom.operators import gwas


def by_subsets(a, b):
    best, value = np.zeros(len(b)), 0.0
    for n in range(1, len(b) + 1):
        for some in combinations(range(len(b)), n):
            x = np.zeros(len(b))
            x[list(some)] = np.linalg.lstsq(a[np.ix_(some, some)], b[list(some)], rcond=None)[0]
            if (x >= 0).all() and x @ a @ x / 2 - b @ x < value - 1e-13:
                best, value = x, x @ a @ x / 2 - b @ x
    return best


def test_active_sets():
    r = np.random.default_rng(0)
    for _ in range(60):
        x, y = r.normal(size=(30, 5)) + 0.5, r.normal(size=30)
        a, b = x.T @ x, x.T @ y
        want = by_subsets(a, b)
        for start in (None, np.ones(5, bool), r.integers(0, 2, 5).astype(bool)):
            assert np.allclose(gwas.nnls_active(a, b, start), want, atol=1e-9)
        assert np.allclose(gwas.nnls(a, b, 20000), want, atol=1e-6)
    assert (gwas.nnls_active(np.eye(3), -np.ones(3)) == 0).all()


def test_deleted_blocks():
    r = np.random.default_rng(1)
    x = np.abs(r.normal(size=(200, 4)))
    y = x @ np.array([0.6, 0.0, 0.02, 0.3]) + r.normal(size=200) * 0.3
    parts = np.array_split(np.arange(200), 10)
    est, cov, deleted = gwas.jackknife_nonnegative(np.array([x[p].T @ x[p] for p in parts]), np.array([x[p].T @ y[p] for p in parts]))
    for p, got in zip(parts, deleted, strict=True):
        rest = np.setdiff1d(np.arange(200), p)
        assert np.allclose(got, by_subsets(x[rest].T @ x[rest], x[rest].T @ y[rest]), atol=1e-9)
    assert np.allclose(est, by_subsets(x.T @ x, x.T @ y), atol=1e-9) and (np.diag(cov) >= 0).all()
    pseudo = 10 * est - 9 * deleted
    assert np.allclose(cov, np.cov(pseudo.T, ddof=1) / 10)
