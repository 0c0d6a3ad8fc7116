"""Known changes and dispersions of made counts; the level of the test where nothing changes; odd rows."""

import numpy as np
import pytest

from strandloom.operators import wald


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(9)
    features, n = 600, 16
    sf, treated = r.uniform(0.5, 2, n), np.arange(n) % 2 == 1
    mean = 10 ** r.uniform(1, 3, features)
    alpha = 0.05 + 2 / mean
    change = np.where(np.arange(features) < 100, np.where(np.arange(features) % 2, 1.5, -1.5), 0.0)
    mu = mean[:, None] * sf * 2.0 ** (change[:, None] * (treated - 0.5))
    k = r.negative_binomial(1 / alpha[:, None], 1 / (1 + alpha[:, None] * mu))
    rows = [(f"s{j:02d}", i, int(k[i, j])) for i in range(features) for j in range(n) if k[i, j]]
    extra = [("other", 0, 50), ("s00", 9999, 0)]
    counts = spark.createDataFrame(rows + extra, "sample string, feature int, cnt long").repartition(6)
    samples = spark.createDataFrame([(f"s{j:02d}", float(sf[j]), bool(treated[j])) for j in range(n)], "sample string, sf double, treated boolean")
    return counts, samples, change, alpha


def test_changes_are_recovered(made):
    counts, samples, change, alpha = made
    got = {x.feature: x for x in wald.wald(counts, samples, lot=100).collect()}
    assert set(got) == set(range(600))
    fc, p, q, se = (np.array([got[i][c] for i in range(600)]) for c in ("log2_fc", "p", "q", "se"))
    assert np.abs(fc[:100] - change[:100]).mean() < 0.4 and (np.abs(fc - change) < 4.5 * se).all()
    assert (q[:100] < 0.05).mean() > 0.9 and (q[100:] < 0.05).mean() < 0.03
    assert 0.02 < (p[100:] < 0.05).mean() < 0.09
    ratio = np.log([got[i].dispersion for i in range(600)]) - np.log(alpha)
    assert abs(np.median(ratio)) < 0.25 and np.std(ratio) < 0.6


def test_groups_of_one_sample(made):
    counts, samples, *_ = made
    with pytest.raises(ValueError, match="two samples"):
        wald.wald(counts, samples.filter("sample <= 's02' and sample <> 's00'"))
