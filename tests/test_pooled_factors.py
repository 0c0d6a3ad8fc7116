"""Pooled size factors: the ring's equations against plain least squares, medians against all features, known factors recovered."""

import numpy as np
import pytest

from strandloom.operators import counts


@pytest.mark.parametrize(("n", "size"), [(7, 3), (12, 4), (20, 20), (31, 8)])
def test_ring_against_least_squares(n, size):
    r = np.random.default_rng(n)
    pooled, own = r.normal(size=n) + size, r.normal(size=n) + 1
    a = np.zeros((n, n))
    for p in range(n):
        a[p, [(p + j) % n for j in range(size)]] = 1
    want = np.linalg.lstsq(np.vstack([a, 1e-3 * np.eye(n)]), np.concatenate([pooled, 1e-3 * own]), rcond=None)[0]
    assert np.allclose(counts._ring_solution(pooled, own, size), want, atol=1e-6)


def by_hand(k, size):
    n = len(k)
    lib = k.sum(1)
    order = np.lexsort((np.arange(n), lib))
    ring = [*order[::2], *order[1::2][::-1]]
    mean = k.mean(0)
    some = mean > 0.1
    pooled = np.array([np.median(k[[ring[(p + j) % n] for j in range(size)]].sum(0)[some] / mean[some]) for p in range(n)])
    sf = np.maximum(counts._ring_solution(pooled, lib[ring] / lib.mean(), size), 1e-6)
    out = np.empty(n)
    out[ring] = sf / sf.mean()
    return out


def test_factors(spark):
    r = np.random.default_rng(2)
    true = r.uniform(0.4, 2.5, 30)
    mean = np.append(10 ** r.uniform(-1.5, 1.5, 300), [0.05] * 20)
    k = r.poisson(true[:, None] * mean)
    df = spark.createDataFrame([(f"s{i:02d}", j, int(v)) for (i, j), v in np.ndenumerate(k) if v], "sample string, feature int, cnt long").repartition(5)
    got = {x.sample: x.sf for x in counts.pooled_factors(df, 6).collect()}
    own = np.array([got[f"s{i:02d}"] for i in range(30)])
    assert np.allclose(own, by_hand(k, 6))
    assert np.corrcoef(own, true)[0, 1] > 0.95 and own.mean() == pytest.approx(1)


def test_few_samples(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 1, 30)], "sample string, feature int, cnt long")
    assert sorted((x.sample, x.sf) for x in counts.pooled_factors(df).collect()) == [("a", 0.5), ("b", 1.5)]
