"""Running sums in value order, corrections and tails against plain numpy and exact counts."""

import io
import math
from contextlib import redirect_stdout
from math import comb

import numpy as np
import pytest

from strandloom.functions import columns, ordered, special


def corrected(p, method):
    m, o = len(p), np.argsort(p, kind="stable")
    s = np.asarray(p)[o]
    last, first = np.searchsorted(s, s, "right"), np.searchsorted(s, s, "left") + 1
    raw = {"bh": s * m / last, "by": s * m / last * sum(1 / i for i in range(1, m + 1)), "holm": s * (m - first + 1), "hochberg": s * (m - last + 1), "bonferroni": s * m}[method]
    if method in ("bh", "by", "hochberg"):
        raw = np.minimum.accumulate(raw[::-1])[::-1]
    if method == "holm":
        raw = np.maximum.accumulate(raw)
    out = np.empty(m)
    out[o] = np.minimum(1, raw)
    return out


@pytest.fixture(scope="module")
def tested(spark):
    r = np.random.default_rng(0)
    p = [None, float("nan"), 0.0, 1.0, *(10 ** (-r.uniform(0, 300)) for _ in range(150)), *(float(x) for x in r.integers(1, 100, 300) / 1000)]
    rows = [(i, i % 3 if i % 7 else None, x) for i, x in enumerate(p)]
    return rows, spark.createDataFrame(rows, "id int, part int, p double").repartition(6)


@pytest.mark.parametrize("by", [[], ["part"]])
def test_corrections(tested, by):
    rows, df = tested
    got = {x.id: x for x in columns.adjust(df, "p", {m: m for m in columns.CORRECTIONS}, by).collect()}
    assert len(got) == len(rows) and got[0].bh is None and got[1].by is None
    groups = {}
    for i, part, p in rows[2:]:
        groups.setdefault(part if by else 0, []).append((i, p))
    for g in groups.values():
        for m in columns.CORRECTIONS:
            assert np.allclose([got[i][m] for i, _ in g], corrected([p for _, p in g], m), rtol=1e-12, atol=0)


def test_own_correction_and_unknown_name(tested):
    _, df = tested
    got = columns.adjust(df, "p", method=lambda p, last, first, m: p * m / last)
    assert {x.id: x.q for x in got.collect()} == {x.id: x.q for x in columns.bh(df, "p").collect()}
    with pytest.raises(ValueError, match="bonferroni"):
        columns.adjust(df, "p", method="other")
    assert columns.bh(df.filter("id < 0"), "p").count() == 0


def test_no_window_sees_all_rows(tested):
    _, df = tested
    out = io.StringIO()
    with redirect_stdout(out):
        columns.bh(df, "p").explain("formatted")
        columns.average_rank(df, "p").explain("formatted")
    windows = [x for x in out.getvalue().split("\n\n") if ") Window\n" in f"{x}\n"]
    assert windows and all("_range" in x for x in windows)


def test_ranks_and_ranges(spark):
    values = [3.0, -2.0, 0.0, -0.0, -0.5, 1e300, -1e-300, math.inf, -math.inf, 3.0, 7.0, 7.0, 7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, v double")
    got = {x.i: x["rank"] for x in columns.average_rank(df, "v").collect()}
    order = sorted(values)
    assert got == {i: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for i, v in enumerate(values)}
    many = spark.createDataFrame([(float(v),) for v in np.sort(np.random.default_rng(1).normal(size=500))], "v double").withColumn("k", ordered.value_range(columns.F.col("v")))
    keys = [x.k for x in many.orderBy("v").collect()]
    assert keys == sorted(keys) and len(set(keys)) > 200


def test_tails_are_exact():
    r, rows = np.random.default_rng(0), []
    for _ in range(300):
        total = int(r.integers(1, 400))
        marked, drawn = int(r.integers(0, total + 1)), int(r.integers(0, total + 1))
        rows.append((int(r.integers(0, min(marked, drawn) + 2)), total, marked, drawn))
    upper, lower = special.hypergeom_tails(*np.array(rows).T)
    for (k, total, marked, drawn), u, w in zip(rows, upper, lower, strict=True):
        top = min(marked, drawn)
        if k > top:
            assert math.isnan(u)
            continue
        each = [comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn) for x in range(top + 1)]
        assert abs(u - sum(each[k:])) < 1e-12 and abs(w - sum(each[:k])) < 1e-12
        assert u > 0.3 or abs(u / sum(each[k:]) - 1) < 1e-9


def test_two_sided_and_undefined(spark):
    df = spark.createDataFrame([(2, 10, 4, 5), (None, 10, 4, 5), (6, 10, 4, 5), (0, 0, 0, 0)], "k long, n long, m long, d long")
    got = [x.p for x in df.select(columns.hypergeom_two_sided_p(*(columns.F.col(c) for c in "knmd")).alias("p")).collect()]
    each = [comb(4, x) * comb(6, 5 - x) / comb(10, 5) for x in range(5)]
    assert got[0] == pytest.approx(2 * min(sum(each[2:]), sum(each[:2]))) and got[1:3] == [1.0, 1.0]
