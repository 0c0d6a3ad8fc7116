"""Interval goldens and properties against nested loops."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandloom.operators import consensus, intervals

S = "chrom string, start long, end long"
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
sets = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 300), st.integers(0, 60)).map(lambda t: (t[0], t[1], t[1] + t[2])), max_size=25)


def frame(spark, rows):
    return spark.createDataFrame(rows, S)


def out(df):
    return sorted(tuple(r) for r in df.collect())


@given(sets, sets, st.sampled_from([8, 64, 1024]), st.integers(0, 5))
@FEW
def test_join_is_nested_loop(spark, a, b, width, slack):
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0] and x[2] > x[1] and y[2] > y[1] and x[1] < y[2] + slack and y[1] - slack < x[2])
    got = out(intervals.overlap_join(frame(spark, a), frame(spark, b), slack=slack, width=width))
    assert got == want
    assert out(intervals.overlap_join(frame(spark, a), frame(spark, b), slack=slack, width=width, long_from=32)) == want


@given(sets, sets)
@FEW
def test_semi_and_anti(spark, a, b):
    hit = [x for x in a if any(x[0] == y[0] and x[2] > x[1] and y[2] > y[1] and x[1] < y[2] and y[1] < x[2] for y in b)]
    fa, fb = frame(spark, a), frame(spark, b)
    assert out(intervals.overlapping(fa, fb, width=32)) == sorted(hit)
    assert out(intervals.not_overlapping(fa, fb, width=32)) == sorted(x for x in a if x not in hit)


@given(sets)
@FEW
def test_merge_and_complement_tile_the_genome(spark, a):
    sizes = spark.createDataFrame([("a", 400), ("b", 400)], "chrom string, length long")
    covered = {(c, p) for c, s, e in a for p in range(s, e)}
    merged, gaps = out(intervals.merge(frame(spark, a))), out(intervals.complement(frame(spark, a), sizes))
    assert {(c, p) for c, s, e in merged for p in range(s, e)} == covered
    assert {(c, p) for c, s, e in gaps for p in range(s, e)} == {(c, p) for c in "ab" for p in range(400)} - covered


def test_goldens(spark):
    rows = [("a", 1, 5), ("a", 4, 9), ("a", 9, 12), ("a", 20, 21)]
    assert out(intervals.merge(frame(spark, rows))) == [("a", 1, 12), ("a", 20, 21)]
    sizes = spark.createDataFrame([("a", 25)], "chrom string, length long")
    assert out(intervals.complement(frame(spark, rows), sizes)) == [("a", 0, 1), ("a", 12, 20), ("a", 21, 25)]
    genes = spark.createDataFrame([("g", "a", 10000, 12000, "+"), ("h", "a", 10000, 12000, "-")], "gene string, chrom string, start long, end long, strand string")
    assert out(intervals.basal_domains(genes).select("gene", "start", "end")) == [("g", 5000, 11000), ("h", 11000, 17000)]
    basal = spark.createDataFrame([("g", "a", 5000, 11000), ("h", "a", 30000, 36000)], "gene string, chrom string, start long, end long")
    far = intervals.distal_domains(basal, spark.createDataFrame([("a", 100000)], "chrom string, length long"))
    assert out(far.select("gene", "start", "end")) == [("g", 0, 30000), ("h", 11000, 100000)]


def test_consensus_joins_close_summits(spark):
    rows = [("a", 100 + k, 140 + k, ".", 120 + k, f"e{i}", 1.0) for i, k in enumerate((0, 2, 4))] + [("a", 900, 940, ".", 920, "e0", 1.0), ("z", 1, 9, ".", 5, "e0", 1.0)]
    peaks = spark.createDataFrame(rows, "chrom string, start long, end long, strand string, summit long, experiment string, score double")
    builder = consensus.ConsensusBuilder(spark.createDataFrame([("a", 2000)], "chrom string, length long"))
    regions, presence = builder.build(peaks, sigma_=10.0)
    assert [(r["start"], r["end"], r["n_peaks"], r["center"], r["id"]) for r in regions.collect()] == [(100, 144, 3, 122, 0)]
    assert presence.count() == 3 and builder.absent(peaks).first()["chrom"] == "z"
