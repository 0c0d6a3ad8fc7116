"""Correlations of many traits at once: known ones recovered, agreement with the regression of one pair, broken traits as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import gwas, traits

M = 4000


@pytest.fixture(scope="module")
def made(spark):
    """A first trait and others of known correlation, on LD scores of 4000 SNPs."""
    r = np.random.default_rng(4)
    ld = r.gamma(3, 20, M)
    base = r.normal(size=(M, 3))
    n, h2 = 50_000.0, 0.5

    def z(rho):
        shared = rho * base[:, 0] + np.sqrt(1 - rho**2) * r.normal(size=M)
        return np.sqrt(n * h2 / M * ld) * shared + r.normal(size=M)

    alleles = [("A", "G"), ("G", "A"), ("T", "C"), ("A", "C")]
    ref = [("A", "G"), ("A", "G"), ("A", "G"), ("A", "C")]
    chrom = [int(x) for x in np.sort(r.integers(1, 6, M))]
    first = spark.createDataFrame([(f"rs{i}", float(v), n, *ref[i % 4]) for i, v in enumerate(z(1.0))], "SNP string, Z double, N double, A1 string, A2 string")
    rows = []
    for name, rho in (("same", 1.0), ("half", 0.5), ("none", 0.0), ("against", -0.7)):
        flip = [1, -1, 1, 1]
        rows += [(name, f"rs{i}", float(v) * flip[i % 4], n, *alleles[i % 4]) for i, v in enumerate(z(rho))]
    rows += [("few", f"rs{i}", 1.0, n, "A", "G") for i in range(0, 40, 4)] + [("elsewhere", f"x{i}", 1.0, n, "A", "G") for i in range(300)]
    rows += [("weak", f"rs{i}", float(v), n, *ref[i % 4]) for i, v in enumerate(r.normal(size=M) * 0.1)]
    others = spark.createDataFrame(rows, "trait string, SNP string, Z double, N double, A1 string, A2 string")
    scores = spark.createDataFrame([(f"rs{i}", chrom[i], i, float(v), float(v), 7.0, float(2 * v)) for i, v in enumerate(ld)], "SNP string, CHR int, BP int, ld double, w_ld double, flat double, twice double")
    return first, others, scores


def test_known_correlations(made):
    first, others, scores = made
    got = {r.trait: r for r in traits.genetic_correlations(first, others, scores.drop("flat", "twice"), {"ld": float(M)}, blocks=40).collect()}
    assert set(got) == {"same", "half", "none", "against", "few", "elsewhere", "weak"}
    for name, rho in (("same", 1.0), ("half", 0.5), ("none", 0.0), ("against", -0.7)):
        x = got[name]
        assert x.reason is None and x.n_snps == M and x.n_blocks == 40
        assert abs(x.rg - rho) < max(4 * x.rg_se, 0.08) and x.rg_se < 0.15
        assert abs(x.h2_2 - 0.5) < 0.15 and x.h2_2_se > 0
    assert got["same"].p < 1e-6 < got["none"].p
    assert got["few"].reason.startswith("fewer") and got["few"].rg is None
    assert (got["elsewhere"].reason, got["elsewhere"].n_snps) == ("no SNP in common", 0)
    assert "positive" in got["weak"].reason and got["weak"].rg is None


def test_scores_that_cannot_be_told_apart(made):
    first, others, scores = made
    some = others.filter("trait in ('same', 'few')")
    twice = {r.trait: r.reason for r in traits.genetic_correlations(first, some, scores.drop("flat"), {"ld": 1.0, "twice": 1.0}, blocks=20).collect()}
    assert twice["same"] == "collinear LD scores" and twice["few"].startswith("fewer")
    flat = {r.trait: r.reason for r in traits.genetic_correlations(first, some, scores.drop("twice"), {"ld": 1.0, "flat": 1.0}, blocks=20).collect()}
    assert flat["same"] == "an LD score without variance"


def test_block_sums_equal_one_pair(made):
    first, others, scores = made
    scores = scores.drop("flat", "twice")
    pairs = traits.with_blocks(traits.paired(first, others.filter("trait = 'half'"), scores), 10)
    got = {r.block: r for r in traits.block_sums(pairs, ["ld"]).collect()}
    one = gwas.align(first.join(scores, "SNP"), others.filter("trait = 'half'"))
    one = gwas.with_blocks(one, ["CHR", "BP", "SNP"], 10).withColumns({"x": F.sqrt(F.col("N") * F.col("N2")) * F.col("ld"), "y": F.col("Z") * F.col("Z2"), "one": F.lit(1.0)})
    want = {r.block: r for r in gwas.block_sums(one, "y", ["x", "one"]).collect()}
    assert set(got) == set(want) and len(got) == 10
    for b, w in want.items():
        g = got[b]
        assert g.n == w.n and [g.xx12_0_0, g.xx12_0_1, g.xy12_0, g.xy12_1] == pytest.approx([w.xx_0_0, w.xx_0_1, w.xy_0, w.xy_1])
