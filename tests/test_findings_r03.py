"""Cases of the third round's findings."""

import numpy as np
import pytest

from strandloom.functions import special
from strandloom.operators import enrich, graph, survival, wald


def test_gene_sets_without_a_term_that_is_small_enough(spark):
    genes = spark.createDataFrame([(i, "chr1", i * 100, i * 100 + 100) for i in range(8)], "gene long, chrom string, start long, end long")
    sets = genes.selectExpr("concat('t', gene % 2) as term", "'n' as name", "gene")
    sizes = spark.createDataFrame([("chr1", 1000)], "chrom string, length long")
    query = spark.createDataFrame([("chr1", i * 9, i * 9 + 1) for i in range(80)], "chrom string, start long, end long")
    got = enrich.GeneSetEnricher(sets, genes, sizes).find_enriched(query, query, max_genes=3)
    assert got.columns == ["term", "name", "p", "beta", "total_hits", "q", "fc", "neg_log10_q"] and got.count() == 0
    assert enrich.GeneSetEnricher(sets, genes, sizes).find_enriched(query, query, max_genes=4).count() == 2


@pytest.mark.parametrize("kind", [int, str])
def test_pairs_of_blocks_are_not_shuffled(spark, kind):
    rng = np.random.default_rng(3)
    sets = {kind(i): {int(x) for x in np.flatnonzero(rng.random(60) < 0.02 + 0.3 * (i % 3))} or {0} for i in range(70)}
    df = spark.createDataFrame([(i, f"f{x}") for i, s in sets.items() for x in s] * 2, f"item {'long' if kind is int else 'string'}, feature string")
    out = graph.pair_counts(df, 60, block=9, lot=40)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(x.a, x.b): (x.n11, x.n10, x.n01, x.n00) for x in out.collect()}
    names = sorted(sets)
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] - sets[b]), len(sets[b] - sets[a]), 60 - len(sets[a] | sets[b])) for k, a in enumerate(names) for b in names[k + 1 :]}
    assert got == want


def test_cox_fits_without_broadcast_times(spark):
    rng = np.random.default_rng(5)
    n = 300
    tte, dead = np.ceil(rng.exponential(40, n)), rng.random(n) < 0.7
    x = {"a": rng.normal(size=n) - tte / 50, "b": rng.normal(size=n), "c": np.full(n, 2.0), "d": np.where(np.arange(n) == 7, np.nan, 1.0 * np.arange(n))}
    times = spark.createDataFrame([(i, float(tte[i]), bool(dead[i])) for i in range(n)], "sample long, tte double, dead boolean")
    values = spark.createDataFrame([(f, i, float(v[i])) for f, v in x.items() for i in range(n)], "feature string, sample long, value double")
    out = survival.cox_univariate(values, times)
    got = {r.feature: (r.coef, r.p) for r in out.collect()}
    assert set(got) == set(x)
    for f, v in x.items():
        assert got[f] == pytest.approx(survival.cox_fit(v, tte, dead), rel=1e-6, abs=1e-12)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert survival.cox_univariate(values, times.limit(9)).count() == 0


def test_tissue_markers_work_out_hits_once(spark):
    regions = spark.createDataFrame([("chr1", i * 10, i * 10 + 5, i) for i in range(40)], "chrom string, start long, end long, region long")
    tissues = spark.createDataFrame([("chr1", i * 30, i * 30 + 12, f"t{i % 3}") for i in range(13)], "chrom string, start long, end long, tissue string")
    out = enrich.tissue_markers(regions, regions.selectExpr("region", "region % 4 as marker"), tissues, width=64)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "chrom" not in plan and "region" not in plan
    hit = {(r, f"t{i % 3}") for r in range(40) for i in range(13) if r * 10 < i * 30 + 12 and i * 30 < r * 10 + 5}
    want = {(m, t): sum((r, t) in hit for r in range(m, 40, 4)) for m in range(4) for t in ("t0", "t1", "t2")}
    assert {(r.marker, r.tissue): r.k for r in out.collect()} == want


def test_zeros_cost_nothing_and_count():
    rng = np.random.default_rng(7)
    sf = np.exp(rng.normal(size=700))
    k = rng.poisson(sf * np.array([[0.01], [0.3], [20.0]])).astype(float)
    k[2, 5] = 4000
    row, at = np.nonzero(k)
    got = wald.Counts(wald.Group(sf), 3, row, sf[at], k[row, at])
    for ln_alpha in (-18.0, -3.0, 0.4, 6.0):
        a = np.exp(ln_alpha)
        q, info = got.levels(np.full(3, a))
        mu = sf * q[:, None]
        w = 1 / (1 + a * mu)
        assert np.abs(((k - mu) * w).sum(1)) == pytest.approx(0, abs=1e-6)
        assert info == pytest.approx((mu * w).sum(1), rel=1e-10)
        q, info = got.levels(np.full(3, a), 8)
        mu, r = sf * q[:, None], 1 / a
        dense = (special.lgamma(k + r) - special.lgamma(k + 1) - special.lgamma(np.full(k.shape, r)) - r * np.log1p(mu / r) + k * (np.log(mu) - np.log(mu + r))).sum(1) - 0.5 * np.log(info)
        assert wald._profile([got], np.full(3, ln_alpha)) == pytest.approx(dense, rel=1e-6, abs=1e-5)


def test_neighbours_shuffle_rows_once_for_many(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (300, 3)).astype(float)  # many equal rows
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, j, r + 1) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), d[i]))[:4].tolist())}
    for block in (1 << 14, 70):
        assert {(r.src, r.dst, r["rank"]) for r in graph.knn(df, 4, block=block).collect()} == want
    assert graph.knn(df.limit(2), 4).count() == 2
    wide = spark.range(9000).selectExpr("id", "array(id * 1.0D) as x")
    plan = graph.knn(wide, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 4" not in plan and "[0,1,2,3,4]" not in plan  # 9000 rows are one block
