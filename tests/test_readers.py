"""Readers over several splits, positions in binary files, lift-over of both strands, draws and fragments."""

import gzip
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals
from strandloom.sources import intervals_io, tables_io


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "64"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_of_many_splits(spark, tmp_path, small_splits):
    r = np.random.default_rng(3)
    texts = {"a.txt": [f"line {i} " + "x" * int(r.integers(0, 60)) for i in range(1500)], "b.txt": ["", "é", "", "last"], "c.txt": ["only"], "d.txt": ["", ""], "e.txt": []}
    (tmp_path / "a.txt").write_text("\n".join(texts["a.txt"]))
    (tmp_path / "b.txt").write_bytes("\r\n".join([*texts["b.txt"], "", "", ""]).encode())
    (tmp_path / "c.txt").write_text("only\n\n\n")
    (tmp_path / "d.txt").write_text("\n\n")
    (tmp_path / "e.txt").write_text("")
    df = intervals_io.numbered_lines(spark, str(tmp_path))
    got = {}
    for x in df.collect():
        got.setdefault(x.file, {})[x.idx] = x.line
    assert {f: [v[i] for i in range(len(v))] for f, v in got.items()} == {f: v for f, v in texts.items() if f in "a.txt b.txt c.txt"}
    assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5
    assert df.count() == 1505 and df.select(F.sum("idx")).first()[0] == 1500 * 1499 // 2 + 6


def test_counts_over_splits_and_gz(spark, tmp_path, small_splits):
    body = "# x\nhead\n" + "".join(f"{i}\n" for i in range(5000))
    (tmp_path / "s1.counts.txt").write_text(body)
    with gzip.open(tmp_path / "s2.counts.txt.gz", "wt") as f:
        f.write(body)
    got = tables_io.read_counts(spark, [str(tmp_path / "s1.counts.txt"), str(tmp_path / "s2.counts.txt.gz")])
    assert got.groupBy("sample").agg(F.count_if(F.col("feature") == F.col("cnt")).alias("n")).orderBy("sample").collect() == [("s1", 5000), ("s2", 5000)]


def test_matrix_of_many_splits(spark, tmp_path, small_splits):
    cells = {(int(r), int(c)): float(r + c) for r, c in np.random.default_rng(1).integers(0, 90, (1200, 2))}
    cells[2, 3] = 7.0
    text = "%%MatrixMarket x\n% more\n3 4 7\n" + "".join(f"{r + 1} {c + 1} {v}\n" for (r, c), v in cells.items())
    (tmp_path / "m.mtx").write_text(text)
    assert {(x.row, x.col): x.value for x in intervals_io.read_matrix(spark, str(tmp_path / "m.mtx")).collect()} == cells


def test_genotypes_by_position(spark, tmp_path):
    people, snps = 7, 1000
    raw = np.random.default_rng(2).integers(0, 256, snps * 2, dtype=np.uint8).tobytes()
    path = tmp_path / "g.bed"
    path.write_bytes(tables_io.MAGIC + raw)
    want = tables_io.decode_genotypes(raw, people)
    df = tables_io.read_genotypes(spark, f"file:{path}", people, lot=64)
    got = df.orderBy("snp_idx").collect()
    assert [x.snp_idx for x in got] == list(range(snps)) and (np.array([x.genotypes for x in got]) == want).all()
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    path.write_bytes(tables_io.MAGIC + raw[:-1])
    with pytest.raises(ValueError, match="whole SNPs"):
        tables_io.read_genotypes(spark, str(path), people)
    path.write_bytes(b"abc" + raw)
    with pytest.raises(ValueError, match="SNP-major"):
        tables_io.read_genotypes(spark, str(path), people)


CHAIN = """# made by hand
chain 100 chr1 1000 + 100 260 chrA 500 + 10 175 1
50 10 5
40 0 10
60

chain 90 chr2 1000 + 0 100 chrB 400 - 20 120 2
100

chain 80 chr3 1000 - 600 700 chrC 300 + 50 150 3
30 0 0
70
"""


@pytest.fixture
def blocks(spark, tmp_path):
    (tmp_path / "x.chain").write_text(CHAIN)
    return intervals_io.read_chain(spark, str(tmp_path / "x.chain")).cache()


def test_chain_blocks(blocks):
    got = sorted(tuple(r)[:7] for r in blocks.collect())
    assert got == [
        ("chr1", 100, 150, "chrA", 10, "+", 500), ("chr1", 160, 200, "chrA", 65, "+", 500), ("chr1", 200, 260, "chrA", 115, "+", 500),
        ("chr2", 0, 100, "chrB", 20, "-", 400),
        ("chr3", 300, 370, "chrC", 150, "-", 300), ("chr3", 370, 400, "chrC", 220, "-", 300),
    ]
    assert blocks.select("chain").distinct().count() == 3


def test_lift_over_by_single_bases(spark, blocks):
    """Every interval against a map of bases: both strands, block borders, gaps."""
    base = {}
    for b in blocks.collect():
        for i in range(b.end - b.start):
            to = b.to_start + i
            base[b.chrom, b.start + i] = (b.to_chrom, b.to_size - 1 - to if b.to_strand == "-" else to, b.to_strand)
    rows = [(c, s, s + n, "+", i) for i, (c, s, n) in enumerate((c, s, n) for c in ("chr1", "chr2", "chr3") for s in range(0, 420, 7) for n in (1, 20, 95))]
    df = spark.createDataFrame([*rows, rows[20]], "chrom string, start long, end long, strand string, name int")
    want = Counter()
    for c, s, e, _, i in [*rows, rows[20]]:
        at = [base[c, x] for x in range(s, e) if (c, x) in base]
        if at and len(at) >= 0.8 * (e - s):
            want[at[0][0], min(x for _, x, _ in at), max(x for _, x, _ in at) + 1, at[0][2], i] += 1
    got = Counter(map(tuple, intervals.lift_over(df, blocks, width=64, min_match=0.8).select("chrom", "start", "end", "strand", "name").collect()))
    assert got == want and {k[3] for k in want} == {"+", "-"} and any(k[2] - k[1] == 95 for k in want)


def test_draws_have_the_exact_size(spark):
    df = spark.createDataFrame([(i, "x") for i in range(300)] + [(7, "x")] * 100, "v long, w string").repartition(5)
    got = intervals.resampled(df, 250, seed=1)
    first, again, other = (Counter(r.v for r in x.collect()) for x in (got, intervals.resampled(df.repartition(3), 250, seed=1), intervals.resampled(df, 250, seed=2)))
    assert sum(first.values()) == 250 and first == again and first != other
    assert 25 < first[7] < 105 and max(v for k, v in first.items() if k != 7) > 1
    assert intervals.resampled(df, 9999).count() == 400 and intervals.resampled(df.limit(0), 5).count() == 0


def test_fragments(spark):
    reads = [("p", "a", 1, "chr1", 10, 20), ("p", "a", 2, "chr1", 90, 99), ("p", "b", 2, "chr1", 12, 15), ("p", "c", 1, None, None, None), ("s", "a", None, "chr1", 10, 20), ("s", "a", None, "chr1", 12, 20)]
    df = spark.createDataFrame(reads, "sample string, name string, mate int, chrom string, start long, end long")
    regions = spark.createDataFrame([(1, "chr1", 0, 100), (2, "chr1", 95, 120), (3, "chr2", 0, 9)], "id int, chrom string, start long, end long")
    assert sorted(map(tuple, intervals.count_fragments(df, regions).collect())) == [("p", 1, 2), ("p", 2, 1), ("s", 1, 2)]
