"""Genetic correlation of one trait with many others, all pairs at once.

A round of the regressions is one aggregation to sums of products by trait and block; the systems of a trait are as large
as its annotations and solved for each trait in a task of its own. A trait that can't be fitted is a row with a reason.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import special
from . import gwas

#: Above this condition number the LD scores of a trait count as collinear.
MOST_CONDITION = 1e5


def paired(first: DataFrame, others: DataFrame, ld: DataFrame) -> DataFrame:
    """first (SNP, Z, N, A1, A2), others (trait and the same), ld (SNP, CHR, BP, w_ld, scores) -> trait, Z, N, Z2, N2 and the columns of ld.

    One inner join on the SNP serves all traits; Z2 is turned where the alleles of the other trait are. SNPs with a null
    anywhere, or whose alleles don't match, are left out.
    """
    table = F.broadcast(first.sparkSession.createDataFrame(gwas.allele_table(), "_key string, _flip boolean"))
    a = first.select("SNP", "Z", "N", gwas.alleles(F.col("A1"), F.col("A2")).alias("_a"))
    b = others.select("trait", "SNP", F.col("Z").alias("Z2"), F.col("N").alias("N2"), gwas.alleles(F.col("A1"), F.col("A2")).alias("_b"))
    out = a.join(ld, "SNP").join(b, "SNP").withColumn("_key", F.concat("_a", "_b")).join(table, "_key")
    return out.withColumn("Z2", F.when(F.col("_flip"), -F.col("Z2")).otherwise(F.col("Z2"))).drop("_key", "_flip", "_a", "_b").dropna()


def with_blocks(pairs: DataFrame, blocks: int, order: list[str] | None = None) -> DataFrame:
    """pairs with a block from 0 within each trait, in genome order: floor(i n / blocks) as separators; `blocks` or the trait's SNPs, if fewer."""
    order = order or ["CHR", "BP", "SNP"]
    sizes = pairs.groupBy("trait", order[0]).agg(F.count(F.lit(1)).alias("_c"))
    each = Window.partitionBy("trait").orderBy(order[0])
    sizes = sizes.withColumns({"_before": F.sum("_c").over(each) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy("trait"))}).drop("_c")
    i = F.col("_before") + F.row_number().over(Window.partitionBy("trait", order[0]).orderBy(*order[1:])) - 1
    b = F.least(F.col("_n"), F.lit(blocks))
    return pairs.join(sizes, ["trait", order[0]]).withColumn("block", F.floor(((i + 1) * b - 1) / F.col("_n")).cast("int")).drop("_before", "_n")


def block_sums(pairs: DataFrame, scores: list[str], weights: dict[str, Column] | None = None) -> DataFrame:
    """pairs with blocks -> by trait and block: n, and for the three regressions (1: Z^2, 2: Z2^2, 12: Z Z2) the sums of w x_i x_j and w x_i y.

    The x are N * score (N, N2 or the root of their product) and a constant, the last. weights: of a regression; 1 if not given.
    """
    n = {"1": F.col("N"), "2": F.col("N2"), "12": F.sqrt(F.col("N") * F.col("N2"))}
    y = {"1": F.col("Z") * F.col("Z"), "2": F.col("Z2") * F.col("Z2"), "12": F.col("Z") * F.col("Z2")}
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in n:
        w = (weights or {}).get(k, F.lit(1.0))
        x = [n[k] * F.col(c) for c in scores] + [F.lit(1.0)]
        aggs += [F.sum(w * x[i] * x[j]).alias(f"xx{k}_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
        aggs += [F.sum(w * x[i] * y[k]).alias(f"xy{k}_{i}") for i in range(len(x))]
    return pairs.groupBy("trait", "block").agg(*aggs)


def _systems(pdf: pd.DataFrame, k: str, p: int) -> tuple[np.ndarray, np.ndarray]:
    xx = np.zeros((len(pdf), p, p))
    for i in range(p):
        for j in range(i, p):
            xx[:, i, j] = xx[:, j, i] = pdf[f"xx{k}_{i}_{j}"]
    return xx, pdf[[f"xy{k}_{i}" for i in range(p)]].to_numpy()


STATE = "trait string, reason string, n_snps long, h1 double, i1 double, h2 double, i2 double, g double, i12 double"
RESULT = "trait string, reason string, n_snps long, n_blocks int, h2_1 double, h2_2 double, h2_2_se double, intercept_2 double, gencov double, gencov_se double, gencov_intercept double, rg double, rg_se double, z double, p double"


def genetic_correlations(first: DataFrame, others: DataFrame, ld: DataFrame, m: dict[str, float], blocks: int = 200, rounds: int = 2, least: int = 200) -> DataFrame:
    """Each trait of others against the first (see paired()): heritabilities, covariance and correlation, with block-jackknife errors.

    m: the score columns of ld and the number of SNPs of each. Scores that don't vary over a trait's SNPs are refused with
    those of a condition number above MOST_CONDITION; further reasons: fewer than `least` SNPs, a singular system, a
    heritability that isn't positive. Such a trait has its reason and what could be estimated; the others have null
    there, and go on. Traits of `others` without any SNP in common with the first are rows too.
    Returns a row per trait: trait, reason, n_snps, n_blocks, h2_1 (of the first over the trait's SNPs), h2_2 and its error and
    intercept, gencov (error, intercept), rg, rg_se, z, p.
    """
    spark, scores, ms = first.sparkSession, list(m), np.array(list(m.values()), float)
    session.ship(spark)
    p, total = len(scores) + 1, float(ms.sum())
    pairs, path = session.stored(with_blocks(paired(first, others, ld), blocks))
    traits = others.select("trait").distinct()

    def checked(pdf: pd.DataFrame) -> tuple[str | None, int]:
        n = int(pdf["n"].sum())
        if n < least:
            return f"fewer than {least} SNPs", n
        xx = pdf[[f"ll_{i}_{j}" for i in range(p - 1) for j in range(i, p - 1)]].sum()
        mean = np.array([pdf[f"l_{i}"].sum() for i in range(p - 1)]) / n
        gram = np.zeros((p - 1, p - 1))
        for i in range(p - 1):
            for j in range(i, p - 1):
                gram[i, j] = gram[j, i] = xx[f"ll_{i}_{j}"]
        if (np.diag(gram) / n - mean**2 <= 1e-12 * np.diag(gram) / n).any():
            return "an LD score without variance", n
        s = np.linalg.svd(gram, compute_uv=False)
        return (None if s[-1] > 0 and math.sqrt(s[0] / s[-1]) <= MOST_CONDITION else "collinear LD scores"), n

    ld_sum = F.greatest(sum((F.col(c) for c in scores), F.lit(0.0)), F.lit(1.0))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        reason, n = checked(pdf)
        s = pdf.sum(numeric_only=True)
        h1, h2 = (total * (s[f"y{k}"] / n - 1) / (s[f"x{k}"] / n) if s[f"x{k}"] else 0.0 for k in "12")
        return pd.DataFrame({"trait": [pdf["trait"].iloc[0]], "reason": [reason], "n_snps": [n], "h1": [h1], "i1": [1.0], "h2": [h2], "i2": [1.0], "g": [0.0], "i12": [0.0]})

    first_sums = [F.count(F.lit(1)).alias("n"), F.sum(F.col("Z") ** 2).alias("y1"), F.sum(F.col("Z2") ** 2).alias("y2"), F.sum(F.col("N") * ld_sum).alias("x1"), F.sum(F.col("N2") * ld_sum).alias("x2")]
    first_sums += [F.sum(F.col(c)).alias(f"l_{i}") for i, c in enumerate(scores)]
    first_sums += [F.sum(F.col(scores[i]) * F.col(scores[j])).alias(f"ll_{i}_{j}") for i in range(p - 1) for j in range(i, p - 1)]
    state, state_path = session.stored(pairs.groupBy("trait").agg(*first_sums).groupBy("trait").applyInPandas(begin, STATE))

    def weighted(state: DataFrame) -> DataFrame:
        rows = pairs.join(state.filter("reason is null").drop("reason", "n_snps"), "trait")
        clip = lambda c, low: F.least(F.lit(1.0), F.greatest(F.lit(low), F.col(c))) / total
        a = clip("h1", 0.0) * F.col("N") * ld_sum + F.col("i1")
        b = clip("h2", 0.0) * F.col("N2") * ld_sum + F.col("i2")
        c = clip("g", -1.0) * F.sqrt(F.col("N") * F.col("N2")) * ld_sum + F.col("i12")
        over = F.greatest(F.col("w_ld"), F.lit(1.0))
        return block_sums(rows, scores, {"1": 1 / (2 * a * a * over), "2": 1 / (2 * b * b * over), "12": 1 / ((a * b + c * c) * over)})

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.copy()
        if len(right) and out["reason"].isna().all():
            try:
                for k, h, i in (("1", "h1", "i1"), ("2", "h2", "i2"), ("12", "g", "i12")):
                    xx, xy = _systems(right, k, p)
                    est = np.linalg.solve(xx.sum(0), xy.sum(0))
                    out[h], out[i] = float((est[:-1] * ms).sum()), float(est[-1])
            except np.linalg.LinAlgError:
                out["reason"] = "a singular system"
        return out

    for _ in range(rounds):
        # the covariance's weights need both heritabilities, which one round more settles
        last = state_path
        state, state_path = session.stored(state.groupBy("trait").cogroup(weighted(state).groupBy("trait")).applyInPandas(step, STATE))
        session.discard(spark, last)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = {c.split()[0]: None for c in RESULT.split(", ")} | {"trait": left["trait"].iloc[0], "reason": left["reason"].iloc[0], "n_snps": int(left["n_snps"].iloc[0])}
        if row["reason"] is None and len(right):
            right = right.sort_values("block")
            row["n_blocks"] = len(right)
            try:
                fit = {k: gwas.jackknife(*_systems(right, k, p)) for k in ("1", "2", "12")}
            except np.linalg.LinAlgError:
                row["reason"] = "a singular system"
                return pd.DataFrame([row])
            h1, h2, g = (float((fit[k][0][:-1] * ms).sum()) for k in ("1", "2", "12"))
            d1, d2, dg = (fit[k][2][:, :-1] @ ms for k in ("1", "2", "12"))
            se = {k: math.sqrt(ms @ fit[k][1][:-1, :-1] @ ms) for k in ("2", "12")}
            row |= {"h2_1": h1, "h2_2": h2, "h2_2_se": se["2"], "intercept_2": float(fit["2"][0][-1]), "gencov": g, "gencov_se": se["12"], "gencov_intercept": float(fit["12"][0][-1])}
            if min(h1, h2) <= 0 or min(d1.min(), d2.min()) <= 0:
                row["reason"] = "a heritability that isn't positive"
            else:
                rg = g / math.sqrt(h1 * h2)
                se = gwas.ratio_jackknife(rg, dg, np.sqrt(d1 * d2))[1]
                row |= {"rg": rg, "rg_se": se, "z": rg / se if se > 0 else None, "p": special.chi2_sf((rg / se) ** 2, 1) if se > 0 else None}
        return pd.DataFrame([row])

    done = state.groupBy("trait").cogroup(weighted(state).groupBy("trait")).applyInPandas(finish, RESULT)
    out, _ = session.stored(traits.join(done, "trait", "left").withColumns({"reason": F.when(F.col("n_snps").isNull(), "no SNP in common").otherwise(F.col("reason")), "n_snps": F.coalesce("n_snps", F.lit(0).cast("long"))}))
    for x in (path, state_path):
        session.discard(spark, x)
    return out
