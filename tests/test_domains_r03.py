"""Links and counts of regions in domains, against brute force."""

import numpy as np

from strandloom.operators import correlate, enrich, intervals


def _sets(spark, seed, n=400, m=60, long=3000):
    rng = np.random.default_rng(seed)
    rows = [(f"p{rng.integers(9)}", f"c{rng.integers(2)}", int(s := rng.integers(-500, 9000)), int(s + rng.integers(0, 300))) for _ in range(n)]
    doms = [(f"g{i}", f"c{rng.integers(2)}", int(s := rng.integers(-500, 9000)), int(s + rng.integers(0, long))) for i in range(m)]
    a = spark.createDataFrame(rows + rows[:50] + [(None, "c0", 5, 9)], "probe string, chrom string, start long, end long")
    b = spark.createDataFrame([*doms, ("g0", "c0", 0, 9000)], "gene string, chrom string, start long, end long")
    left, right = ([tuple(r) for r in x.collect()] for x in (a, b))
    right = list(right)
    hit = [(p, g) for p, c, s, e in left for g, d, t, u in right if c == d and s < u and t < e and s < e and t < u]
    return a, b, hit


def test_links_are_emitted_once(spark):
    for width in (1 << 12, 200):
        a, b, hit = _sets(spark, width)
        out = correlate.link(a, b, width=width)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x in hit if x[1] != "g0"}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [probe" not in plan  # pairs aren't told apart after the join


def test_counts_need_no_pairs(spark):
    for tile in (1 << 17, 512):
        a, b, hit = _sets(spark, tile)
        want = {g: sum(x[1] == g for x in hit) for g in {x[1] for x in hit}}
        assert {r.gene: r.n for r in intervals.overlap_counts(a, b, "gene", tile=tile).collect()} == want
    sets = enrich.GeneSetEnricher(b.selectExpr("gene as term", "gene as name", "gene"), b, None)
    got = sets._hits(a)
    assert {r.gene: r.hits for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
