"""Correlation of regions with the genes in whose domains they lie."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from .intervals import overlap_join, unique_names


def link(regions: DataFrame, domains: DataFrame, width: int = 1 << 12) -> DataFrame:
    """(probe, gene) of regions (probe) inside gene domains, each once; genes whose name occurs twice are left out.

    Of a probe's regions, in order of start, an earlier one touches a domain as well if it ends behind the domain's start;
    only the first emits the pair, so that pairs needn't be told apart afterwards. width: near the domains' usual length.
    """
    before = Window.partitionBy("probe", "chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    regions = regions.filter("end > start").select("probe", "chrom", "start", "end", F.max("end").over(before).alias("_reached"))
    regions = regions.filter("_reached is null or end > _reached")
    pairs = overlap_join(regions, unique_names(domains).select("chrom", "start", "end", "gene"), width=width)
    return pairs.filter("_reached is null or start_b >= _reached").select("probe", F.col("gene_b").alias("gene"))


def spearman(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs (probe, gene), a (probe, sample, value), b (gene, sample, value) -> r over common samples; unknown ids go."""
    ra = fc.average_rank(a, "value", ["probe"], "ra").select("probe", "sample", "ra")
    rb = fc.average_rank(b, "value", ["gene"], "rb").select("gene", "sample", "rb")
    return pairs.join(ra, "probe").join(rb, ["gene", "sample"]).groupBy("probe", "gene").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("r"))


def null_correlations(a: DataFrame, b: DataFrame, n: int = 100_000, seed: int = 42) -> np.ndarray:
    """Sorted correlations of n random pairs of a probe and a gene; n bounds what reaches the driver."""
    probes, genes = (x.select(c).distinct().orderBy(F.xxhash64(c, F.lit(seed)), c).limit(n).toPandas()[c] for x, c in ((a, "probe"), (b, "gene")))
    rng = np.random.default_rng(seed)
    pairs = pd.DataFrame({"probe": rng.choice(probes, n), "gene": rng.choice(genes, n)}).drop_duplicates()
    got = spearman(a.sparkSession.createDataFrame(pairs), a, b).select("r").dropna().toPandas()["r"].to_numpy()
    return np.sort(got)


def test(correlations: DataFrame, null: np.ndarray, alternative: str = "two-sided") -> DataFrame:
    """Empirical p: the share of the null below (greater: 1 - that of smaller ones), or twice the smaller share."""
    null_ = correlations.sparkSession.sparkContext.broadcast(null)

    def p(r: pd.Series) -> pd.Series:
        n = max(len(null_.value), 1)
        below, above = np.searchsorted(null_.value, r, "left") / n, 1 - np.searchsorted(null_.value, r, "right") / n
        return pd.Series({"greater": above, "less": below}.get(alternative, 2 * np.minimum(below, above)))

    return fc.bh(correlations.filter("r is not null and not isnan(r)").withColumn("p", F.pandas_udf(p, "double")("r")), "p")


def over_representation(tested: DataFrame, flagged: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of flagged pairs (probe, gene) among significant ones and among all, and their ratio."""
    rows = tested.join(flagged.withColumn("_f", F.lit(1)), ["probe", "gene"], "left")
    sig = F.col("q") < alpha
    return rows.agg(F.avg(F.when(sig, F.coalesce("_f", F.lit(0)))).alias("in_significant"), F.avg(F.coalesce("_f", F.lit(0))).alias("in_all")).withColumn("ratio", F.col("in_significant") / F.col("in_all"))


def first_per_sample(rows: DataFrame, sample: str, order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(sample).orderBy(*order))).filter("_r = 1").drop("_r")
