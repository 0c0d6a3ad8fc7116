"""Readers and writers on small files, and the streaming variants."""

import pytest

from strandloom.sources import intervals_io, tables_io
from strandloom.streaming import arrivals


def put(path, text):
    path.write_text(text)
    return str(path)


def test_peaks(spark, tmp_path):
    bed = put(tmp_path / "x.bed", "chr1\t10\t20\tp\t7\t+\t14\t15\nchr1\t30\t40\tp\t7\t\t34\t35\n")
    got = intervals_io.read_peaks(spark, bed).orderBy("start").collect()
    assert [(r["summit"], r["strand"], r["experiment"]) for r in got] == [(14, "+", "x.bed"), (34, ".", "x.bed")]
    narrow = put(tmp_path / "y.narrowPeak", "chr1\t10\t20\tp\t7\t.\t1\t2\t3\t4\n")
    assert intervals_io.read_peaks(spark, narrow, "narrowPeak").first()["summit"] == 14
    assert intervals_io.read_peaks(spark, narrow, "narrowPeak", infer_center=True).first()["summit"] == 15
    with pytest.raises(TypeError):
        intervals_io.read_peaks(spark, bed, "sam")


def test_annotation_files(spark, tmp_path):
    gtf = put(tmp_path / "g.gtf", 'chr1\tx\tgene\t11\t20\t.\t-\t.\tgene_id "i1"; gene_type "lnc"; gene_name "G1";\nchr1\tx\texon\t11\t20\t.\t-\t.\tgene_id "i1";\n')
    assert tuple(intervals_io.read_gtf(spark, gtf).first()) == ("G1", "chr1", 10, 20, "-", "i1", "lnc")
    gmt = put(tmp_path / "a.gmt", "t1\tone\tA\tB\nt2\ttwo\tC\n"), put(tmp_path / "b.gmt", "t1\tuno\tZ\n")
    assert sorted(map(tuple, intervals_io.read_gmt(spark, list(gmt)).collect())) == [("t1", "uno", "Z"), ("t2", "two", "C")]
    sizes = put(tmp_path / "c.sizes", "chr1\t100\nchr2\t50\n")
    assert [tuple(r) for r in intervals_io.read_chrom_sizes(spark, sizes).orderBy("idx").collect()] == [("chr1", 100, 0), ("chr2", 50, 1)]


def test_matrix_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2.0), (2, 0, 1.0)], "row long, col long, value double")
    intervals_io.write_matrix(df, str(tmp_path / "m"), 3, 2)
    assert sorted(map(tuple, intervals_io.read_matrix(spark, str(tmp_path / "m")).collect())) == [(0, 1, 2.0), (2, 0, 1.0)]


def test_counts_and_tables(spark, tmp_path):
    c = put(tmp_path / "s1.counts.txt", "# x\nhead\n5\n0\n7\n")
    assert sorted(map(tuple, tables_io.read_counts(spark, c).collect())) == [("s1", 0, 5), ("s1", 1, 0), ("s1", 2, 7)]
    s = put(tmp_path / "s1.summary", "Status\tn\nAssigned\t10\nUnassigned_Unmapped\t5\nUnassigned_X\t3\n")
    assert tuple(tables_io.read_library_sizes(spark, s).select("reads", "assigned").first()) == (13, 10)
    g = put(tmp_path / "x.gct", "#1\n2\t2\nName\tDescription\tA\tB\ng1\td\t1\t2\n")
    assert sorted(map(tuple, tables_io.read_gct(spark, g).collect())) == [("A", "g1", 1.0), ("B", "g1", 2.0)]
    z = put(tmp_path / "x.sumstats", "SNP A1 A2 Z N\nrs1 A C 1.5 10\nrs2 A C . 10\n")
    assert [tuple(r) for r in tables_io.read_sumstats(spark, z).orderBy("idx").select("SNP", "Z").collect()] == [("rs1", 1.5), ("rs2", None)]
    m = put(tmp_path / "1.M", "10 20\n"), put(tmp_path / "2.M", "1 2\n")
    assert tables_io.read_m(spark, list(m)) == [11.0, 22.0]


def test_genotype_file(spark, tmp_path):
    (tmp_path / "x.bed").write_bytes(tables_io.MAGIC + bytes([0b11100100, 0b00000001]))
    got = tables_io.read_genotypes(spark, str(tmp_path / "x.bed"), 4, lot=1).orderBy("snp_idx").collect()
    assert [(r["snp_idx"], list(r["genotypes"])) for r in got] == [(0, [0, 9, 1, 2]), (1, [9, 0, 0, 0])]


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.tsv", "chr1\t1\t9\tE1.POLR2A.x_peak1\t9\t+\t4\nchrEBV\t1\t9\tE1.POLR2A.x_peak2\t9\t+\t4\nchr1\t1\t9\tE1.CTCF.x_peak3\t9\t+\t4\n")
    q = arrivals.start(arrivals.experiment_sizes(arrivals.peaks(spark, str(tmp_path / "in"))), "sizes", str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("sizes").collect()] == [("E1.POLR2A.x", 1)]
