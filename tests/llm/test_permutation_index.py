"""Recall of the permutation index on a table of which a third is one tight group."""

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import permutation_index


def test_recall_beside_a_tight_group(spark):
    r = np.random.default_rng(0)
    n, dim, k = 15000, 64, 5
    hot = n // 3
    v = r.normal(size=(n, dim))
    v[: hot] = r.normal(size=dim) + 0.05 * r.normal(size=(hot, dim))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = permutation_index.PermutationIndex().search(frame, F.col("vec_id") % 100 == 0).collect()
    u = permutation_index.unit(v)
    share = {True: [], False: []}
    for q in range(0, n, 100):
        near = [x for x in np.argsort(-(u @ u[q]))[: k + 1].tolist() if x != q][:k]
        share[q < hot].append(len({x["vec_id"] for x in found if x["query_id"] == q} & set(near)) / k)
    assert min(np.mean(share[True]), np.mean(share[False])) >= 0.9


def test_cosines_of_extreme_vectors():
    r = np.random.default_rng(1)
    v, q = r.normal(size=(50, 64)), r.normal(size=64)
    plain = (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))
    assert permutation_index.cosines(v, q).tolist() == plain.tolist()  # to the last bit
    for a, b in ((1e200, 1e-200), (1e-300, 1e300), (1e300, 1e300)):
        assert np.allclose(permutation_index.cosines(v * a, q * b), plain, rtol=1e-12)


def test_few_rows_and_extreme_vectors(spark):
    v = np.random.default_rng(2).normal(size=(40, 8))
    scale = [10.0 ** (300 * (-1) ** i * (i % 3 == 0)) for i in range(40)]
    frame = spark.createDataFrame([(i, (x * s).tolist()) for i, (x, s) in enumerate(zip(v, scale, strict=True))], "vec_id long, embedding array<double>")
    u = permutation_index.unit(v)
    for n in (3, 40):
        got = permutation_index.PermutationIndex().search(frame.filter(F.col("vec_id") < n), F.lit(True)).collect()
        for q in range(n):
            own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            near = [x for x in np.argsort(-(u[:n] @ u[q])).tolist() if x != q][:5]
            assert [r["vec_id"] for r in own] == near and np.allclose([r["score"] for r in own], u[near] @ u[q], rtol=1e-9, atol=1e-12)
