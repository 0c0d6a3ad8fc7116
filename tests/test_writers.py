"""Writers read back, lists of SNPs and people, rank tests of signals, split tables, densities by each peak's width."""

import gzip
import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import special
from strandloom.operators import consensus, counts, enrich, gwas
from strandloom.sources import intervals_io, tables_io


def lines(path, suffix=""):
    opened = gzip.open if suffix else open
    return [x.rstrip("\n") for p in sorted(path.glob(f"part-*{suffix}")) for x in opened(p, "rt")]


def test_gtf_lines(spark, tmp_path):
    regions = spark.createDataFrame([(0, "chr1", 9, 20), (1, "chrM", 0, 5), (2, "chr1_KI270706v1_random", 4, 6)], "id long, chrom string, start long, end long")
    intervals_io.write_lines(intervals_io.gtf(regions, "own"), str(tmp_path / "x.gtf"), "_k")
    got = lines(tmp_path / "x.gtf")
    assert got[0] == '1\town\texon\t10\t20\t.\t+\t.\tgene_biotype "protein_coding"; gene_id "0"; transcript_id "0"; gene_name "0";'
    assert [x.split("\t")[0] for x in got] == ["1", "MT", "KI270706.1"] * 2 and [x.split("\t")[6] for x in got] == ["+"] * 3 + ["-"] * 3
    assert got[5].endswith('gene_name "5";')


def test_consensus_folder(spark, tmp_path):
    peaks = spark.createDataFrame([("chr1", 10 * i + j, 10 * i + j + 8, 10 * i + j + 4, f"e{j}", ".", 1.0) for i in (3, 40, 90) for j in range(3)], "chrom string, start long, end long, summit long, experiment string, strand string, score double")
    sizes = spark.createDataFrame([("chr1", 2000)], "chrom string, length long")
    regions, presence = consensus.ConsensusBuilder(sizes).build(peaks)
    intervals_io.write_consensus(regions, presence, peaks, sizes, str(tmp_path))
    bed = lines(tmp_path / "consensuses.bed")
    assert len(bed) == regions.count() == 3 and bed[0].split("\t")[0] == "chr1" and [x.split("\t")[3] for x in bed] == ["0", "1", "2"]
    assert lines(tmp_path / "datasets.txt") == ["e0", "e1", "e2"]
    assert intervals_io.read_matrix(spark, str(tmp_path / "matrix.mtx")).count() == 9
    stats = dict(x.split("\t") for x in lines(tmp_path / "dataset_stats.txt"))
    assert stats == {"Average peak size": "8.0", "Number of Peaks": "9", "Number of consensus peaks": "3", "Number of experiments": "3", "Genome size": "2000"}


def test_ld_score_files(spark, tmp_path):
    df = spark.createDataFrame([(1, f"rs{i}", i, 0.5, float(i), 1.0, 0.01 * i) for i in range(20)], "CHR int, SNP string, BP long, CM double, a double, b double, maf double")
    tables_io.write_ld_scores(df, df, ["a", "b"], str(tmp_path / "x.1"))
    got = lines(tmp_path / "x.1.l2.ldscore", ".gz")
    assert got[0] == "CHR\tSNP\tBP\ta\tb" and [x.split("\t")[2] for x in got if x[0] != "C"] == [str(i) for i in range(20)]
    assert lines(tmp_path / "x.1.l2.M") == ["190.0\t20.0"] and lines(tmp_path / "x.1.l2.M_5_50") == ["175.0\t14.0"]
    tables_io.write_table(df.select("SNP", F.when(F.col("BP") > 5, F.col("a")).alias("a")), str(tmp_path / "t"), ["SNP"])
    assert "rs1\tNA" in lines(tmp_path / "t")


def test_lists_of_snps_and_people(spark):
    df = spark.createDataFrame([(f"rs{i}", [i, 1, 2, 9]) for i in range(3)], "SNP string, genotypes array<int>")
    keep = spark.createDataFrame([("rs0",), ("rs2",), ("rs2",), ("other",)], "SNP string")
    assert sorted((r.SNP, r.genotypes) for r in gwas.restrict(df, keep, [3, 0]).collect()) == [("rs0", [9, 0]), ("rs2", [9, 2])]
    assert gwas.restrict(df).count() == 3


def test_condition_and_correlation(spark):
    x = np.random.default_rng(0).normal(size=(50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    assert gwas.condition_number(df, ["a", "b", "c"]) == pytest.approx(np.linalg.cond(x))
    got = {(r.a, r.b): r.r for r in gwas.correlations(df, ["a", "b", "c"]).collect()}
    assert all(got["abc"[i], "abc"[j]] == pytest.approx(np.corrcoef(x.T)[i, j]) for i, j in product(range(3), range(3)))
    assert gwas.condition_number(df.select("a", (F.col("a") * 2).alias("b")), ["a", "b"]) > 1e7


def test_signals_by_rank(spark):
    r = np.random.default_rng(3)
    value = r.integers(0, 5, (12, 10)) * (r.random((12, 10)) > 0.3)
    value[0, :5], value[0, 5:] = 9, 0
    label = ["x" if j < 5 else "y" for j in range(10)]
    values = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(value) if v] + [(0, 77, 3.0)], "consensus int, experiment int, value double")
    annotation = spark.createDataFrame([(j, label[j]) for j in range(10)], "experiment int, label string")
    got = {(x.consensus, x.label): x for x in enrich.top_by_signal(values, annotation).collect()}
    assert len(got) == 2 * sum(v.any() for v in value)
    for (i, name), x in got.items():
        a = [v for v, n in zip(value[i], label, strict=True) if n == name]
        b = [v for v, n in zip(value[i], label, strict=True) if n != name]
        u = sum((p > q) + 0.5 * (p == q) for p, q in product(a, b))
        tie = sum(t**3 - t for t in np.unique(value[i], return_counts=True)[1])
        sd = math.sqrt(25 / 12 * (11 - tie / 90))
        assert x.u == u and x.k == sum(v > 0 for v in a)
        assert x.p == pytest.approx(special.norm_sf((u - 12.5 - 0.5) / sd) if sd else 1.0)
    assert got[0, "x"].significant and not got[0, "y"].significant


def test_tests_that_are_not_listed_count(spark):
    presence = spark.createDataFrame([(c, e) for c in range(40) for e in ([0, 1] if c == 0 else [2 + c % 6])], "consensus int, experiment int")
    annotation = spark.createDataFrame([(e, "x" if e < 2 else "y") for e in range(8)], "experiment int, label string")
    got = {(x.consensus, x.label): x for x in enrich.top_per_annotation(presence, annotation).collect()}
    assert got[0, "x"].q == pytest.approx(min(1.0, got[0, "x"].p * 40))


def test_split_tables(spark):
    tested = spark.createDataFrame([("a", 1, 0.01, 2.0, True, False), ("a", 2, 0.02, -1.0, False, True), ("a", 3, 0.001, 1.0, True, False), ("b", 1, 0.5, 0.0, False, False)], "label string, feature int, p double, lfc double, upreg boolean, downreg boolean")
    up, down = counts.regulated(tested, ["label", "feature"])
    assert list(map(tuple, up.collect())) == [("a", 3), ("a", 1)] and list(map(tuple, down.collect())) == [("a", 2)]


def test_density_by_each_peaks_width(spark):
    """Two wide peaks 60 apart make one region, two narrow ones two."""
    sizes = spark.createDataFrame([("chr1", 5000)], "chrom string, length long")
    rows = []
    for at, half in ((1000, 100), (3000, 10)):
        rows += [("chr1", at + d - half, at + d + half, at + d, f"e{j}", ".", 1.0) for d in (0, 60) for j in range(2)]
    peaks = spark.createDataFrame(rows, "chrom string, start long, end long, summit long, experiment string, strand string, score double")
    regions, _ = consensus.ConsensusBuilder(sizes).build(peaks, per_peak=0.5)
    got = sorted((x.center, x.n_peaks) for x in regions.collect())
    assert got == [(1030, 4), (3000, 2), (3060, 2)]
