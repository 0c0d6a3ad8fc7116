"""Closed-form values and properties of the numeric kernels."""

import math
from fractions import Fraction

import numpy as np
import pytest

from strandloom.functions import special
from strandloom.operators import counts, enrich, graph, gwas, survival
from strandloom.sources import tables_io


@pytest.mark.parametrize(("args", "p"), [((50, 10, 8, 4), 0.0406987780199492), ((100, 20, 30, 10), 0.0306964293543367), ((10, 5, 5, 5), 1 / 252), ((1000, 50, 100, 12), 0.002458338967142133)])
def test_hypergeom(args, p):
    total, marked, drawn, k = args
    assert special.hypergeom_sf(k, total, marked, drawn) == pytest.approx(p, rel=1e-9)


def test_tails():
    assert special.binom_two_sided(9, 20, 0.3) == pytest.approx(0.2266629257539566)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.t_sf(2.2281388519649385, 10) == pytest.approx(0.025)
    assert special.norm_sf(1.959963984540054) == pytest.approx(0.025)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert special.chi2_isf_1(0.05) == pytest.approx(3.841458820694124)


def test_mann_whitney(spark):
    values = [(float(x), True) for x in (1, 2, 2, 3)] + [(float(x), False) for x in (2, 4, 5, 6, 6)]
    row = counts.mann_whitney(spark.createDataFrame(values, "value double, in_group boolean")).first()
    assert (row["r0"], row["u0"], row["tie"]) == (12, 2, 30)
    assert row["sd"] == pytest.approx(3.9965262694272665)
    assert row["p"] == pytest.approx(0.060568860202657455)


def test_bh(spark):
    from strandloom.functions.columns import bh

    df = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.5, 0.002])), "i int, p double")
    assert [r["q"] for r in bh(df, "p").orderBy("i").collect()] == pytest.approx([0.025, 0.05, 0.05, 0.5, 0.01])


def test_allele_table():
    table = dict(gwas.allele_table())
    assert table["ACCA"] is True and table["ACTG"] is False and table["ACGT"] is True
    assert "ATAT" not in table and len(table) == 32


def test_headers():
    assert gwas.resolve_headers(["rsid", "P-value", "effect.allele"]) == {"rsid": "SNP", "P-value": "P", "effect.allele": "A1"}
    with pytest.raises(ValueError):
        gwas.resolve_headers(["rsid", "snp"])


def test_jackknife_separators(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "CHR int, BP int")
    sizes = gwas.with_blocks(df, ["CHR", "BP"], 3).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in sizes] == [3, 3, 4]


def test_heritability_recovers_slope(spark):
    rng = np.random.default_rng(1)
    ld = rng.uniform(1, 50, 4000)
    z = rng.normal(size=4000) * np.sqrt(1 + 0.4 * 50_000 / 1e6 * ld)
    df = spark.createDataFrame([(1, i, f"rs{i}", float(a), 50_000.0, float(b), float(b)) for i, (a, b) in enumerate(zip(z, ld, strict=True))], "CHR int, BP int, SNP string, Z double, N double, L2 double, w_ld double")
    r = gwas.heritability(df, ["L2"], [1e6], blocks=40)
    assert abs(r["total"] - 0.4) < 4 * r["total_se"] and abs(r["intercept"] - 1) < 4 * r["intercept_se"]


def test_two_step_errors_hold_those_of_the_intercept(spark):
    """Against a plain jackknife that leaves out each block in both steps, at the weights of the whole."""
    rng = np.random.default_rng(4)
    n, blocks, m, size = 4000, 40, 1e6, 50_000.0
    ld = rng.uniform(1, 50, n)
    z = rng.normal(size=n) * np.sqrt(1 + 0.4 * size / m * ld)
    df = spark.createDataFrame([(1, i, f"rs{i}", float(a), size, float(b), float(b)) for i, (a, b) in enumerate(zip(z, ld, strict=True))], "CHR int, BP int, SNP string, Z double, N double, L2 double, w_ld double")
    two = gwas.heritability(df, ["L2"], [m], blocks=blocks, two_step=3.0)
    fixed = gwas.heritability(df, ["L2"], [m], blocks=blocks, intercept=two["intercept"])
    assert two["total"] == pytest.approx(fixed["total"], rel=1e-2)  # the weights start from another slope
    assert two["total_se"] > 1.05 * fixed["total_se"]

    chi2, block = z * z, (np.arange(n) + 1) * blocks - 1
    block = block // n

    def fit(x, y, w):
        return np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)

    def weights(h2, a, x):
        return 1 / (2 * (a + min(1.0, max(0.0, h2)) / m * size * x) ** 2) / x

    def settled(x, y, ld, a):
        """Weights after two rounds; a: the fixed intercept, or None."""
        h2, inter = m * (chi2.mean() - 1) / (ld_all * size).mean(), 1.0 if a is None else a
        for _ in range(2):
            est = fit(x, y, weights(h2, inter, ld))
            h2, inter = est[0] * m / size, est[-1] if a is None else a
        return weights(h2, inter, ld)

    ld_all, low = ld, chi2 < 3.0
    both = np.column_stack([ld[low], np.ones(low.sum())])
    w1 = settled(both, chi2[low], ld[low], None)
    step = fit(both, chi2[low], w1)[1]
    w2 = settled(ld[:, None], chi2 - step, ld, step)
    left = []
    for k in range(blocks):
        first, second = block[low] != k, block != k
        own = fit(both[first], chi2[low][first], w1[first])[1]
        left.append((fit(ld[second, None], (chi2 - own)[second], w2[second])[0] * m / size, own))
    whole = np.array([fit(ld[:, None], chi2 - step, w2)[0] * m / size, step])
    pseudo = blocks * whole - (blocks - 1) * np.array(left)
    assert [two["total"], two["intercept"]] == pytest.approx(whole, rel=1e-6)
    assert [two["total_se"], two["intercept_se"]] == pytest.approx(np.sqrt(pseudo.var(axis=0, ddof=1) / blocks), rel=0.03)


def test_tails_of_large_counts():
    for k, n, p in ((60, 100, 0.5), (3, 100, 0.5), (1, 2000, 1e-4), (700, 2000, 0.3)):
        exact = sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k, n + 1))
        assert special.binom_sf(k, n, p) == pytest.approx(float(exact), rel=1e-9)
    for k, total, marked, drawn in ((5, 1000, 100, 50), (1, 3000, 30, 20), (180, 2000, 300, 1000), (40, 500, 60, 300)):
        exact = Fraction(sum(math.comb(marked, i) * math.comb(total - marked, drawn - i) for i in range(k, min(marked, drawn) + 1)), math.comb(total, drawn))
        assert special.hypergeom_sf(k, total, marked, drawn) == pytest.approx(float(exact), rel=1e-9)
    assert special.binom_sf(50_000_000, 100_000_000, 0.5) == pytest.approx(0.5, abs=1e-4)


def test_ld_scores_match_brute_force(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 3, (30, 40))
    rows = [(1, f"rs{i}", i * 10, [int(v) for v in x]) for i, x in enumerate(g)]
    got = {r["SNP"]: r["L2"] for r in gwas.ld_scores(spark.createDataFrame(rows, "CHR int, SNP string, BP long, genotypes array<int>"), 50).collect()}
    x = np.stack([gwas.standardise(v) for v in g])
    r2 = (x @ x.T / 40) ** 2
    adjusted = r2 - (1 - r2) / 38
    for i in range(30):
        assert got[f"rs{i}"] == pytest.approx(sum(adjusted[i, j] for j in range(30) if abs(i - j) * 10 <= 50))


def test_genotypes():
    raw = bytes([0b11100100])
    assert tables_io.decode_genotypes(raw, 4).tolist() == [[0, 9, 1, 2]]


def test_cox_finds_the_sign():
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    t = rng.exponential(np.exp(-0.8 * x))
    b, p = survival.cox_fit(x, t, np.ones(300, bool))
    assert 0.5 < b < 1.1 and p < 1e-6
    assert survival.cox_fit(np.zeros(5), np.arange(5.0), np.ones(5, bool)) == (0.0, 1.0)


def test_best_cut():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=120)
    t = rng.exponential(np.where(x > 0.6, 0.2, 2.0))
    cut, _, p = survival.best_cut(x, t, np.ones(120, bool), perms=200)
    assert 0.45 < cut < 0.75 and p < 0.02


def test_nb_glm_finds_enriched_set():
    rng = np.random.default_rng(5)
    member = (np.arange(400) < 40).astype(float)
    expected = rng.uniform(1, 5, 400)
    p, beta = enrich.nb1_glm(rng.poisson(expected * np.where(member > 0, 2.5, 1)), expected, member)
    assert p < 1e-6 and 0.6 < beta < 1.3


def test_set_model_without_dispersion_has_an_error():
    expected = np.full(20000, 7.0)
    hits = np.tile([5.0, 6, 7, 8, 9], 4000)  # less varied than Poisson counts
    member = np.arange(20000) % 25 == 3
    p, beta = enrich.nb1_glm(hits, expected, member)
    assert beta == pytest.approx(math.log(hits[member].mean() / hits[~member].mean()), abs=1e-3)
    assert 0 < p < 1


def test_communities_split_cliques():
    e = [(a, b) for base in (0, 5) for a in range(base, base + 5) for b in range(base, base + 5) if a < b] + [(4, 5)]
    s, d = np.array(e).T
    labels, _ = graph.local_moving(s, d, np.ones(len(s)), 10, 1.0, 0)
    assert len(set(labels[:5])) == len(set(labels[5:])) == 1 and labels[0] != labels[9]


def test_linkage_order_keeps_clusters_together():
    x = np.array([[0.0], [10.0], [0.1], [10.1], [0.2]])
    o = graph.linkage_order(x).tolist()
    assert {0, 2, 4} in (set(o[:3]), set(o[2:]))


def test_trend_falls():
    rng = np.random.default_rng(6)
    mean = rng.uniform(1, 100, 800)
    _, y = counts.trend(mean, 1 / mean + rng.uniform(0, 0.01, 800))
    assert (np.diff(y) <= 1e-12).all() and math.isfinite(y[0])


def test_small_columns(spark):
    from strandloom.functions import columns as fc
    from strandloom.operators import intervals

    df = spark.createDataFrame([("Sox2(HMG)/mES", 0.0, 1.0), ("p53/x", 2.5, 0.0), ("n", 4.0, 1.0), ("o", 9.0, 0.5)], "m string, x double, y double")
    assert [r[0] for r in df.select(fc.motif_name(df["m"])).collect()] == ["Sox2", "p53", "n", "o"]
    assert {r["bin"]: r["n"] for r in fc.histogram(df, "x", [0, 1, 3, 4]).collect()} == {0: 1, 1: 1, 2: 1}
    assert sorted(map(tuple, fc.density_grid(df, "x", "y", 2, (0, 4, 0, 1)).collect())) == [(0, 1, 1), (1, 0, 1), (1, 1, 1)]
    assert len(set(fc.palette(12))) == 12
    reads = spark.createDataFrame([("s", "r1", "a", 0, 10), ("s", "r1", "a", 12, 20), ("s", "r2", "a", 5, 30)], "sample string, name string, chrom string, start long, end long")
    regions = spark.createDataFrame([("a", 8, 15, 1), ("a", 25, 40, 2)], "chrom string, start long, end long, id long")
    assert sorted(map(tuple, intervals.count_reads(reads, regions).collect())) == [("s", 1, 2), ("s", 2, 1)]
