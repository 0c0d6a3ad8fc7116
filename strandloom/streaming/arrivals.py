"""File-arrival variants of the batch preparation: peaks and counts are taken up as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PEAKS = "chrom string, start long, end long, name string, score double, strand string, summit long"


def peaks(spark: SparkSession, folder: str, target: str = "POLR2A", least_score: float = 5.0, excluded: str = "chrEBV") -> DataFrame:
    """Usable peaks of newly arrived tab-separated files: the target's, above the score, off the excluded chromosome."""
    rows = spark.readStream.schema(PEAKS).option("sep", "\t").csv(folder)
    ok = (F.get(F.split("name", r"\."), F.lit(1)) == target) & (F.col("score") > least_score) & (F.col("chrom") != excluded)
    return rows.filter(ok).withColumn("experiment", F.substring_index("name", "_peak", 1))


def experiment_sizes(stream: DataFrame) -> DataFrame:
    """Running number of peaks per experiment."""
    return stream.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"))


def feature_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals and detections by feature of arriving count files (sample, feature, cnt) in Parquet."""
    rows = spark.readStream.schema("sample string, feature long, cnt long").parquet(folder)
    return rows.groupBy("feature").agg(F.sum("cnt").alias("reads"), F.count_if(F.col("cnt") > 0).alias("samples"))


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Takes up what is there, in memory under the given name, and stops."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
