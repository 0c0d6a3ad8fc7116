"""Domain tables derived from the driver's tables, in Spark and, alike, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chrom(c: str):
    return F.concat(F.lit("chr"), (F.col(c) % 5).cast("string"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 100 + F.col("l_linenumber") * 10
    size = F.col("l_quantity").cast("bigint")
    return li.select(
        _chrom("l_suppkey").alias("chrom"), start.alias("start"), (start + size).alias("end"), (start + F.expr("cast(l_quantity as bigint) div 2")).alias("summit"),
        F.col("l_suppkey").alias("experiment"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_custkey") * 130 + F.col("o_orderkey") % 97
    return table(spark, sf_dir, "orders").select(
        _chrom("o_custkey").alias("chrom"), start.alias("start"), (start + 50).alias("end"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("entry"), F.when(F.col("o_orderstatus") == "O", "+").otherwise("-").alias("strand")
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("p_partkey") * 100
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gene"), _chrom("p_partkey").alias("chrom"), start.alias("start"), (start + F.col("p_size") * 10).cast("bigint").alias("end"),
        F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_brand").alias("term"),
    )


def chrom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes as long as the parts reach, rounded up."""
    top = table(spark, sf_dir, "part").agg((F.max("p_partkey") * 100 + 20000).cast("bigint").alias("length"))
    return spark.range(5).join(F.broadcast(top)).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), "length", F.col("id").alias("idx"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").cast("bigint").alias("cnt"))


def tissues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("sample"), F.col("n_regionkey").cast("bigint").alias("label"))


def follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patient"), days.alias("days"), (F.col("o_orderstatus") == "F").alias("dead"), F.col("o_orderpriority").alias("cohort"), (F.col("o_custkey") % 2 == 0).alias("treated"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")


def sumstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.array(*[F.lit(x) for x in "ACGT"])
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("rs"), (k % 1900).cast("string")).alias("SNP"), k.alias("row"), ((k % 22) + 1).cast("bigint").alias("CHR"), (k * 37).alias("BP"),
        F.get(base, (k % 4).cast("int")).alias("A1"), F.get(base, (F.expr("p_partkey div 4") % 4).cast("int")).alias("A2"),
        ((k % 1000 + 1) / 1000.0).alias("P"), (1000 + (k % 7) * 100).cast("double").alias("N_CAS"), (1500 + (k % 11) * 100).cast("double").alias("N_CON"),
        ((k % 100) / 100.0).alias("FRQ"), (0.85 + (k % 20) / 100.0).alias("INFO"), ((k * 13 % 601 - 300) / 100.0).alias("Z"),
        (F.col("p_size") * 1.0).alias("ld"), (F.col("p_retailprice") / 100.0).alias("annot"),
    )


_TABLES = {
    "peaks": """peaks AS (SELECT chrom, s AS start, s + z AS "end", s + z // 2 AS summit, experiment, strand FROM (
        SELECT 'chr' || (l_suppkey % 5) AS chrom, l_partkey * 100 + l_linenumber * 10 AS s, CAST(l_quantity AS BIGINT) AS z,
               l_suppkey AS experiment, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem))""",
    "catalog": """catalog AS (SELECT 'chr' || (o_custkey % 5) AS chrom, o_custkey * 130 + o_orderkey % 97 AS start,
        o_custkey * 130 + o_orderkey % 97 + 50 AS "end", o_orderpriority AS name, o_orderkey AS entry,
        CASE WHEN o_orderstatus = 'O' THEN '+' ELSE '-' END AS strand FROM orders)""",
    "genes": """genes AS (SELECT p_partkey AS gene, 'chr' || (p_partkey % 5) AS chrom, p_partkey * 100 AS start,
        CAST(p_partkey * 100 + p_size * 10 AS BIGINT) AS "end", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS term FROM part)""",
    "chrom_sizes": """chrom_sizes AS (SELECT 'chr' || i AS chrom, l AS length, i AS idx FROM range(5) t(i),
        (SELECT CAST(max(p_partkey) * 100 + 20000 AS BIGINT) AS l FROM part))""",
    "counts": """counts AS (SELECT l_suppkey AS sample, l_partkey AS feature, CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem GROUP BY 1, 2)""",
    "tissues": """tissues AS (SELECT s_suppkey AS sample, CAST(n_regionkey AS BIGINT) AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "follow_up": """follow_up AS (SELECT o_orderkey AS patient, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days,
        o_orderstatus = 'F' AS dead, o_orderpriority AS cohort, o_custkey % 2 = 0 AS treated FROM orders)""",
    "vectors": """vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)""",
    "sumstats": """sumstats AS (SELECT 'rs' || (p_partkey % 1900) AS "SNP", p_partkey AS row, CAST(p_partkey % 22 + 1 AS BIGINT) AS "CHR", p_partkey * 37 AS "BP",
        substr('ACGT', CAST(p_partkey % 4 + 1 AS INTEGER), 1) AS "A1", substr('ACGT', CAST((p_partkey // 4) % 4 + 1 AS INTEGER), 1) AS "A2",
        CAST((p_partkey % 1000 + 1) / 1000.0 AS DOUBLE) AS "P", CAST(1000 + (p_partkey % 7) * 100 AS DOUBLE) AS "N_CAS", CAST(1500 + (p_partkey % 11) * 100 AS DOUBLE) AS "N_CON",
        CAST((p_partkey % 100) / 100.0 AS DOUBLE) AS "FRQ", CAST(0.85 + (p_partkey % 20) / 100.0 AS DOUBLE) AS "INFO", CAST((p_partkey * 13 % 601 - 300) / 100.0 AS DOUBLE) AS "Z",
        CAST(p_size AS DOUBLE) AS ld, CAST(p_retailprice / 100.0 AS DOUBLE) AS annot FROM part)""",
}


def sql(body: str, *names: str) -> str:
    """DuckDB SQL: the named tables, then body, which may go on with ", more AS (...)"."""
    return "WITH " + ",\n".join(_TABLES[n] for n in names) + "\n" + body
