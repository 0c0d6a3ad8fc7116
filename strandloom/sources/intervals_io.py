"""Readers and writers of interval files. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = ("bed", "narrowPeak")


def _columns(spark: SparkSession, paths: str | list[str], n: int, header: bool = False) -> DataFrame:
    """Tab-separated text as _c0 ... strings with the file's name."""
    lines = spark.read.text(paths).select(F.split("value", "\t").alias("_x"), F.col("_metadata.file_name").alias("file"))
    lines = lines.filter((F.size("_x") > 1) & ~F.get("_x", F.lit(0)).rlike("^(#|track|browser)"))
    return lines.select("file", *[F.get("_x", F.lit(i)).alias(f"_c{i}") for i in range(n)])


def _strand(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("."))


def read_peaks(spark: SparkSession, paths: str | list[str], fmt: str = "bed", score_column: int | None = None, infer_center: bool = False) -> DataFrame:
    """Peaks of a folder or of listed files (gz too): chrom, start, end, strand, summit, score, experiment (file name).

    bed: strand in column 5, summit in column 6; narrowPeak: strand in 5, summit = start + column 9, counted from 0.
    infer_center: the middle as the summit instead.
    """
    if fmt not in FORMATS:
        raise TypeError(f"format has to be one of {', '.join(FORMATS)}")
    rows = _columns(spark, paths.split(",") if isinstance(paths, str) else paths, 12)
    start, end = F.col("_c1").try_cast("bigint"), F.col("_c2").try_cast("bigint")
    summit = F.col("_c6").try_cast("bigint") if fmt == "bed" else start + F.col("_c9").try_cast("bigint")
    if infer_center:
        summit = ((start + end) * 0.5).cast("bigint")
    score = F.lit(1.0) if score_column is None else F.col(f"_c{score_column}").try_cast("double")
    return rows.select(F.col("_c0").alias("chrom"), start.alias("start"), end.alias("end"), _strand("_c5").alias("strand"), summit.alias("summit"), score.alias("score"), F.col("file").alias("experiment")).filter("start is not null and end is not null")


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """chrom, start, end, name, score, strand; missing columns are null, a missing strand is '.'."""
    rows = _columns(spark, paths, 6)
    return rows.select(F.col("_c0").alias("chrom"), F.col("_c1").try_cast("bigint").alias("start"), F.col("_c2").try_cast("bigint").alias("end"), F.col("_c3").alias("name"), F.col("_c4").try_cast("double").alias("score"), _strand("_c5").alias("strand")).filter("start is not null and end is not null")


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length and idx, the order in the file."""
    rows = numbered_lines(spark, path)
    x = F.split("line", r"\s+")
    return rows.filter("line <> ''").select(F.get(x, F.lit(0)).alias("chrom"), F.get(x, F.lit(1)).try_cast("bigint").alias("length"), F.col("idx"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, idx (long, from 0 in each file), line: text files whose lines are known by their place; empty lines at the end are left out.

    Files are read by Spark's own splits, many tasks to a large one. A first pass counts the lines of each split; a line's
    number is its place in its split after the lines of the splits before it. Compressed files are one split each.
    """
    rows = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\r$", "").alias("line"),
    )
    # rows of a split stand together in a partition, in their order
    splits = rows.groupBy("_path", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("line") != "", F.col("_id"))).alias("_last"))
    each = Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(each), F.lit(0)))
    splits = splits.withColumn("_end", F.max(F.col("_before") + F.col("_last") - F.col("_first")).over(Window.partitionBy("_path")))
    out = rows.join(splits.select("_path", "_at", "_first", "_before", "_end"), ["_path", "_at"]).withColumn("idx", F.col("_before") + F.col("_id") - F.col("_first"))
    return out.filter(F.col("idx") <= F.col("_end")).select("file", "idx", "line")


def read_gtf(spark: SparkSession, path: str, feature: str = "gene", gene_type: str | None = None, gene_column: str = "gene_name") -> DataFrame:
    """gene, chrom, start (0-based), end, strand, gene_id, gene_type of one kind of feature."""
    rows = _columns(spark, path, 9).filter(F.col("_c2") == feature)

    def attribute(name: str) -> Column:
        return F.nullif(F.regexp_extract("_c8", f'(?:^|[; ]){name} "([^"]*)"', 1), F.lit(""))

    out = rows.select(attribute(gene_column).alias("gene"), F.col("_c0").alias("chrom"), (F.col("_c3").cast("bigint") - 1).alias("start"), F.col("_c4").cast("bigint").alias("end"), F.col("_c6").alias("strand"), attribute("gene_id").alias("gene_id"), attribute("gene_type").alias("gene_type"))
    return out.filter(F.col("gene_type") == gene_type) if gene_type else out


def read_gmt(spark: SparkSession, paths: list[str]) -> DataFrame:
    """term, name, gene; of a term in several files (or lines), the last counts."""
    out = None
    for k, p in enumerate(paths):
        part = numbered_lines(spark, p).select(F.lit(k).alias("k"), "idx", F.split("line", "\t").alias("x"))
        out = part if out is None else out.unionByName(part)
    out = out.filter(F.size("x") > 2).select(F.get("x", F.lit(0)).alias("term"), F.get("x", F.lit(1)).alias("name"), F.slice("x", 3, 1 << 20).alias("genes"), "k", "idx")
    last = out.groupBy("term").agg(F.max_by(F.struct("name", "genes"), F.struct("k", "idx")).alias("v"))
    return last.select("term", F.col("v.name").alias("name"), F.explode("v.genes").alias("gene")).filter("gene <> ''")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Aligned blocks of a chain file for intervals.lift_over(): chrom, start, end, to_chrom, to_start, to_strand, to_size, chain.

    Blocks follow each other by the gaps between them, which are summed within a chain. Where the source is given on its
    reverse strand, both sides are mirrored, so that all source coordinates are forward ones.
    """
    lines = numbered_lines(spark, path).filter("line <> '' and not startswith(line, '#')").select("file", "idx", F.split(F.trim("line"), r"\s+").alias("x"))
    is_head = F.get("x", F.lit(0)) == "chain"
    head = F.last(F.when(is_head, F.struct("idx", "x")), ignorenulls=True).over(Window.partitionBy("file").orderBy("idx"))
    rows = lines.withColumns({"h": head, "is_head": is_head}).filter("not is_head and h is not null")
    number = lambda c, i: F.get(c, F.lit(i)).cast("bigint")
    before = Window.partitionBy("file", "h.idx").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    size = number("x", 0)
    past = lambda i: F.coalesce(F.sum(size + F.coalesce(number("x", i), F.lit(0))).over(before), F.lit(0))
    rows = rows.withColumns({"size": size, "t": number("h.x", 5) + past(1), "q": number("h.x", 10) + past(2), "ts": number("h.x", 3), "qs": number("h.x", 8), "forward": F.get("h.x", F.lit(4)) == "+", "to": F.get("h.x", F.lit(9))})
    start = F.when(F.col("forward"), F.col("t")).otherwise(F.col("ts") - F.col("t") - F.col("size"))
    to_start = F.when(F.col("forward"), F.col("q")).otherwise(F.col("qs") - F.col("q") - F.col("size"))
    strand = F.when(F.col("forward"), F.col("to")).otherwise(F.when(F.col("to") == "+", "-").otherwise("+"))
    return rows.select(F.get("h.x", F.lit(2)).alias("chrom"), start.alias("start"), (start + F.col("size")).alias("end"), F.get("h.x", F.lit(7)).alias("to_chrom"), to_start.alias("to_start"), strand.alias("to_strand"), F.col("qs").alias("to_size"), F.concat_ws(":", "file", "h.idx").alias("chain"))


def write_bed(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None, by: str | None = None) -> None:
    """Tab-separated without a header: one ordered file, or a folder per value of `by`."""
    rows = df.select(*columns, *([by] if by and by not in columns else []))
    if by:
        rows.repartition(by).sortWithinPartitions(*(order or columns[:2])).write.mode("overwrite").partitionBy(by).csv(path, sep="\t")
    else:
        rows.coalesce(1).sortWithinPartitions(*(order or columns[:2])).write.mode("overwrite").csv(path, sep="\t")


def saf(regions: DataFrame, offset: int = -1) -> DataFrame:
    """GeneID, Chr, Start, End, Strand on both strands, End shifted by offset; chrX_v becomes X.v as in gene annotations."""
    both = regions.withColumn("Strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    return both.select(F.col("id").cast("string").alias("GeneID"), chrom_alias(F.col("chrom")).alias("Chr"), F.col("start").alias("Start"), (F.col("end") + offset).alias("End"), "Strand")


def gtf(regions: DataFrame, source: str = "consensus", biotype: str = "protein_coding") -> DataFrame:
    """line: an exon of each region (id from 0, chrom, start, end) on the forward, then on the reverse strand, numbered on; 1-based, chromosomes as in gene annotations."""
    n = regions.count()
    both = regions.withColumn("_s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_k", F.col("id") + F.col("_s") * n)
    name = F.when(F.col("chrom") == "chrM", "MT").when(F.col("chrom").contains("_"), chrom_alias(F.col("chrom"))).otherwise(F.regexp_replace("chrom", "^chr", ""))
    key = F.col("_k").cast("string")
    more = F.concat(F.lit(f'gene_biotype "{biotype}"; gene_id "'), key, F.lit('"; transcript_id "'), key, F.lit('"; gene_name "'), key, F.lit('";'))
    cells = [name, F.lit(source), F.lit("exon"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.when(F.col("_s") == 0, "+").otherwise("-"), F.lit("."), more]
    return both.select("_k", F.concat_ws("\t", *cells).alias("line"))


def write_lines(lines: DataFrame, path: str, order: str) -> None:
    """The column `line` as text, in ascending order over the files' names."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def write_consensus(consensus: DataFrame, presence: DataFrame, peaks: DataFrame, chrom_sizes: DataFrame, path: str) -> None:
    """consensuses.bed, matrix.mtx (consensus by dataset), datasets.txt (the columns' names) and dataset_stats.txt under path.

    consensus and presence as ConsensusBuilder.build() gives them; datasets are numbered in the order of their names.
    """
    columns = ["chrom", "start", "end", "id", "n_peaks", "strand", "center", "center_end"]
    write_lines(consensus.select("id", F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("line")), f"{path}/consensuses.bed", "id")
    placed = dense_rank_of(presence, "experiment", "col")
    names = placed.select("col", F.col("experiment").cast("string").alias("line")).distinct()
    write_lines(names, f"{path}/datasets.txt", "col")
    sets, regions = names.count(), consensus.count()
    write_matrix(placed.select(F.col("id").alias("row"), "col", "value"), f"{path}/matrix.mtx", regions, sets)
    size = peaks.agg(F.avg(F.col("end") - F.col("start")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    genome = chrom_sizes.agg(F.sum("length")).first()[0]
    told = [("Average peak size", size["size"]), ("Number of Peaks", size["n"]), ("Number of consensus peaks", regions), ("Number of experiments", sets), ("Genome size", genome)]
    write_lines(consensus.sparkSession.createDataFrame([(i, f"{k}\t{v}") for i, (k, v) in enumerate(told)], "i int, line string"), f"{path}/dataset_stats.txt", "i")


def chrom_alias(chrom: Column) -> Column:
    """chr1_KI270706v1_random -> KI270706.1; other names unchanged."""
    part = F.get(F.split(chrom, "_"), F.lit(1))
    return F.when(chrom.contains("_"), F.replace(part, F.lit("v"), F.lit("."))).otherwise(chrom)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """MatrixMarket coordinates as (row, col, value), from 0; the first line that is no comment holds the sizes, and entries without a value are 1."""
    x = F.split(F.trim("line"), r"\s+")
    lines = numbered_lines(spark, path).filter(~F.col("line").startswith("%") & (F.trim("line") != ""))
    sizes = lines.agg(F.min(F.struct("file", "idx")).alias("at"))
    rows = lines.join(F.broadcast(sizes), F.struct("file", "idx") != F.col("at"))  # one row
    return rows.select((F.get(x, F.lit(0)).cast("bigint") - 1).alias("row"), (F.get(x, F.lit(1)).cast("bigint") - 1).alias("col"), F.coalesce(F.get(x, F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))


def write_matrix(df: DataFrame, path: str, rows: int, cols: int) -> None:
    """(row, col, value) from 0 as one MatrixMarket file."""
    body = df.select((F.col("row") + 1).alias("r"), (F.col("col") + 1).alias("c"), "value")
    n = body.count()
    lines = body.select(F.lit(1).alias("k"), "c", "r", F.concat_ws(" ", "r", "c", "value").alias("line"))
    spark = df.sparkSession
    head = spark.createDataFrame([(0, 0, 0, f"%%MatrixMarket matrix coordinate real general\n{rows} {cols} {n}")], lines.schema)
    head.unionByName(lines).coalesce(1).sortWithinPartitions("k", "c", "r").select("line").write.mode("overwrite").text(path)


def dense_rank_of(df: DataFrame, column: str, name: str) -> DataFrame:
    """Numbers distinct values in order; the distinct values are the small side."""
    d = df.select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(F.broadcast(d), column)
