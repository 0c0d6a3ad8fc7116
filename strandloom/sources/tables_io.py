"""Readers of counts, manifests, summary statistics, LD scores and genotypes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from .intervals_io import numbered_lines

MAGIC = b"\x6c\x1b\x01"  # fixed value: plink's magic bytes and SNP-major mode


def read_counts(spark: SparkSession, paths: str | list[str], skip: int = 2) -> DataFrame:
    """(sample, feature, cnt): one integer per line after `skip` lines, the place being the feature; sample: file name."""
    rows = numbered_lines(spark, paths).filter(F.col("idx") >= skip)
    name = F.regexp_replace("file", r"(\.counts)?\.txt(\.gz)?$", "")
    return rows.select(name.alias("sample"), (F.col("idx") - skip).cast("bigint").alias("feature"), F.trim("line").try_cast("int").alias("cnt")).filter("cnt is not null")


def read_binned_counts(spark: SparkSession, paths: str | list[str], bins: int = 100, skip: int = 1) -> DataFrame:
    """(sample, region, bin, cnt) of files with `bins` consecutive lines per region."""
    rows = read_counts(spark, paths, skip)
    return rows.select("sample", F.expr(f"feature div {bins}").alias("region"), (F.col("feature") % bins).alias("bin"), "cnt")


def read_library_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, reads, assigned): sums over a summary's statuses but Unassigned_Unmapped."""
    x = F.split("line", "\t")
    rows = numbered_lines(spark, paths).filter("idx > 0").select("file", F.get(x, F.lit(0)).alias("status"), F.get(x, F.lit(1)).try_cast("bigint").alias("n"))
    return rows.filter("status <> 'Unassigned_Unmapped'").groupBy("file").agg(F.sum("n").alias("reads"), F.sum(F.when(F.col("status") == "Assigned", F.col("n")).otherwise(0)).alias("assigned"))


def missing_samples(expected: DataFrame, found: DataFrame, sample: str = "sample") -> DataFrame:
    """Samples that no file was found for; the others go on without them."""
    return expected.join(found.select(sample).distinct(), sample, "left_anti")


def read_gct(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """(sample, gene, cnt) of a matrix with columns Name, Description, samples."""
    lines = numbered_lines(spark, path)
    names = lines.filter(F.col("idx") == skip).first()["line"].split("\t")[2:]
    x = F.split("line", "\t")
    samples = F.array(*[F.lit(n) for n in names])
    rows = lines.filter(F.col("idx") > skip).select(F.get(x, F.lit(0)).alias("gene"), F.explode(F.arrays_zip(samples.alias("s"), F.slice(x, 3, len(names)).alias("v"))).alias("z"))
    return rows.select(F.col("z.s").alias("sample"), "gene", F.col("z.v").try_cast("double").alias("cnt"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest with object_id; adds id, the part behind the last slash."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.withColumn("id", F.element_at(F.split("object_id", "/"), -1))


def gwas_manifest(rows: DataFrame) -> DataFrame:
    """Traits of high confidence, none of them raw, the first address of each (phenotype, significance, url)."""
    ok = rows.filter((F.col("significance") == "z7") & ~F.col("phenotype").endswith("raw"))
    return ok.withColumn("_r", F.row_number().over(Window.partitionBy("phenotype").orderBy("url"))).filter("_r = 1").drop("_r")


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, r double, g double, b double").csv(path, header=True)


def _whitespace_table(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], DataFrame]:
    lines = numbered_lines(spark, paths).withColumn("x", F.split(F.trim("line"), r"\s+"))
    names = lines.filter("idx = 0").orderBy("file").first()["x"]
    return names, lines.filter("idx > 0 and line <> ''")


def read_sumstats(spark: SparkSession, path: str) -> DataFrame:
    """SNP, Z, N, A1, A2 and the line's place; '.' and NA are null."""
    names, rows = _whitespace_table(spark, path)
    kinds = {"Z": "double", "N": "double"}
    cols = []
    for c in ("SNP", "Z", "N", "A1", "A2"):
        if c in names:
            v = F.get("x", F.lit(names.index(c)))
            cols.append(F.when(v.isin(".", "NA"), None).otherwise(v).try_cast(kinds.get(c, "string")).alias(c))
    return rows.select("idx", *cols)


def read_raw_stats(spark: SparkSession, path: str, resolved: dict[str, str]) -> DataFrame:
    """Columns by canonical field; resolved: header -> field, as from gwas.resolve_headers()."""
    names, rows = _whitespace_table(spark, path)
    text = {"SNP", "A1", "A2"}
    cols = []
    for header, field in resolved.items():
        v = F.get("x", F.lit(names.index(header)))
        cols.append(F.when(v.isin(".", "NA"), None).otherwise(v).try_cast("string" if field in text else "double").alias(field))
    return rows.select("idx", *cols)


def read_ld_scores(spark: SparkSession, prefix: str, chromosomes: range = range(1, 23), suffix: str = ".l2.ldscore") -> DataFrame:
    """CHR, SNP, BP and score columns of the chromosomes' files ('@' or the prefix's end stands for the number); first row per SNP."""
    import glob

    pattern = prefix if "@" in prefix else prefix + "@"
    paths = [p for c in chromosomes for ext in ("", ".gz") for p in glob.glob(pattern.replace("@", str(c)) + suffix + ext)]
    names, rows = _whitespace_table(spark, paths)
    cols = [F.get("x", F.lit(i)).try_cast("string" if n == "SNP" else "double").alias(n) for i, n in enumerate(names) if n not in ("CM", "MAF")]
    out = rows.select(*cols).withColumns({"CHR": F.col("CHR").cast("int"), "BP": F.col("BP").cast("bigint")})
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("SNP").orderBy("CHR", "BP"))).filter("_r = 1").drop("_r")


def beside(tables: list[DataFrame]) -> DataFrame:
    """LD scores of several files side by side, columns numbered; the SNPs have to be the same."""
    out = tables[0].select("CHR", "SNP", "BP", *[F.col(c).alias(f"{c}_0") for c in tables[0].columns if c not in ("CHR", "SNP", "BP")])
    n = out.count()
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.select("SNP", *[F.col(c).alias(f"{c}_{i}") for c in t.columns if c not in ("CHR", "SNP", "BP")]), "SNP")
        if t.count() != n or out.count() != n:
            raise ValueError("the files hold different SNPs")
    return out


def read_m(spark: SparkSession, paths: list[str]) -> list[float]:
    """Sums of the numbers in .M files, place by place."""
    x = numbered_lines(spark, paths).filter("idx = 0").select(F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "v"))
    return [r["s"] for r in x.groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("s")).orderBy("i").collect()]


def read_annotations(spark: SparkSession, path: str, frequencies: DataFrame | None = None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """CHR, BP, SNP, CM and annotations; with frequencies (SNP, FRQ) only SNPs strictly between low and high."""
    names, rows = _whitespace_table(spark, path)
    out = rows.select("idx", *[F.get("x", F.lit(i)).try_cast("string" if n == "SNP" else "double").alias(n) for i, n in enumerate(names)])
    if frequencies is None:
        return out
    return out.join(frequencies.filter((F.col("FRQ") > low) & (F.col("FRQ") < high)).select("SNP"), "SNP", "left_semi")


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    x = F.split(F.trim("line"), r"\s+")
    return numbered_lines(spark, path).filter("line <> ''").select(
        F.col("idx").cast("bigint").alias("snp_idx"), F.get(x, F.lit(0)).cast("int").alias("CHR"), F.get(x, F.lit(1)).alias("SNP"), F.get(x, F.lit(2)).cast("double").alias("CM"),
        F.get(x, F.lit(3)).cast("bigint").alias("BP"), F.get(x, F.lit(4)).alias("A1"), F.get(x, F.lit(5)).alias("A2"),
    )


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).filter("line <> ''").select(F.col("idx").alias("person"), F.get(F.split(F.trim("line"), r"\s+"), F.lit(1)).alias("IID"))


def decode_genotypes(raw: bytes, people: int) -> np.ndarray:
    """SNP by person: 0, 1 or 2 copies of the second allele, 9 if missing, of a SNP-major file's bytes behind the header."""
    per = -(-people // 4)
    bits = np.frombuffer(raw, np.uint8).reshape(-1, per)
    two = (bits[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    code = np.array([0, 9, 1, 2], np.int8)  # fixed values: 00, 01 (missing), 10, 11
    return code[two.reshape(len(bits), -1)[:, :people]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path; file:/x is file:///x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_genotypes(spark: SparkSession, path: str, people: int, lot: int = 4096) -> DataFrame:
    """(snp_idx, genotypes) of a plink .bed; each task opens the file at the bytes of its lots of SNPs.

    path: of a store that Arrow opens (local, s3, gs, hdfs), under the same name on every machine.
    """
    per, (store, where) = -(-people // 4), _opened(path)
    size = store.get_file_info(where).size
    with store.open_input_file(where) as f:
        if size < 3 or f.read_at(3, 0) != MAGIC:
            raise ValueError("not a SNP-major plink .bed file")
    snps, rest = divmod(size - 3, per)
    if rest:
        raise ValueError(f"the file doesn't hold whole SNPs of {people} people")
    lots = -(-snps // lot)
    session.ship(spark)

    def decode(frames):
        store, where = _opened(path)
        with store.open_input_file(where) as f:
            for pdf in frames:
                for k in pdf["id"].tolist():
                    first = k * lot
                    g = decode_genotypes(f.read_at(min(lot, snps - first) * per, 3 + first * per), people)
                    yield pd.DataFrame({"snp_idx": first + np.arange(len(g)), "genotypes": [x.tolist() for x in g]})

    # some 32 MB a task, but no fewer tasks than run at once
    tasks = max(1, min(lots, max(size >> 25, spark.sparkContext.defaultParallelism)))
    return spark.range(0, lots, 1, tasks).mapInPandas(decode, "snp_idx long, genotypes array<int>")


def write_table(df: DataFrame, path: str, order: list[str], sep: str = "\t", compression: str = "none") -> None:
    """A text table with a header in each file, in ascending order over the files' names; nulls are NA."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="NA", compression=compression)


def write_ld_scores(scores: DataFrame, annot: DataFrame, names: list[str], prefix: str, frequency: str = "maf") -> None:
    """prefix.l2.ldscore (CHR, SNP, BP, scores; gzip), .l2.M and .l2.M_5_50 (a number per annotation), .annot (CHR, BP, SNP, CM and the annotations)."""
    from ..operators.gwas import m_counts

    write_table(scores.select("CHR", "SNP", "BP", *names), f"{prefix}.l2.ldscore", ["CHR", "BP", "SNP"], compression="gzip")
    row = m_counts(annot, names, frequency).first()
    for suffix, key in (("M", "m_"), ("M_5_50", "m_5_50_")):
        line = "\t".join(str(row[key + n]) for n in names)
        scores.sparkSession.createDataFrame([(line,)], "line string").coalesce(1).write.mode("overwrite").text(f"{prefix}.l2.{suffix}")
    write_table(annot.select("CHR", "BP", "SNP", "CM", *names), f"{prefix}.annot", ["CHR", "BP", "SNP"], compression="gzip")


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Named results as Parquet folders."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
