"""Tasks that hold no whole sample, flag or twice the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import ordered
from strandloom.operators import intervals
from strandloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unbroadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.unset(name)


def test_reads_are_not_laid_together_by_sample(unbroadcast):
    s = unbroadcast
    reads = s.createDataFrame([(i % 2, f"r{i // 2}", 1 + i // 2 % 2 if i % 2 else None, "c", i, i + 5) for i in range(40)], "sample long, name string, mate int, chrom string, start long, end long")
    out = intervals.count_fragments(reads, s.createDataFrame([("c", 0, 21, 7)], "chrom string, start long, end long, id long"), width=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("SortMergeJoin [sample" in x for x in plan.splitlines())
    assert {(r["sample"], r.region): r.cnt for r in out.collect()} == {(0, 7): 11, (1, 7): 10}


def test_percentiles_by_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.integers(-40, 40, 301)] + [("b", float(x)) for x in rng.normal(size=50)] + [("c", 3.0), ("d", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    out = ordered.percentiles(df, ["k"], "v", shares)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: r[1:] for r in out.collect()}
    want = {r.k: r[1:] for r in df.groupBy("k").agg(*[F.percentile("v", F.lit(p)) for p in shares.values()]).collect()}
    assert set(got) == set(want) == {"a", "b", "c", "d", None} and want["d"] == (None,) * 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want if k != "d") and got["d"] == want["d"]
    assert "percentile" not in catalogue.QUERIES["sc_percentile_cutpoints"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_detection_tells_rows_apart_once(spark):
    plan = catalogue.QUERIES["mk_detected_in"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [" in x for x in plan.splitlines()) == 1
