"""Association summary statistics: cleaning, allele-aware joins, LD scores, weighted regression with a block jackknife."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special

# Canonical field of each usual header, upper case, with - and . as _.
ALIASES = {
    "SNP": "SNP", "MARKERNAME": "SNP", "SNPID": "SNP", "RS": "SNP", "RSID": "SNP", "RS_NUMBER": "SNP", "RS_NUMBERS": "SNP",
    "NSTUDY": "NSTUDY", "N_STUDY": "NSTUDY", "NSTUDIES": "NSTUDY", "N_STUDIES": "NSTUDY",
    "P": "P", "PVALUE": "P", "P_VALUE": "P", "PVAL": "P", "P_VAL": "P", "GC_PVALUE": "P",
    "A1": "A1", "ALLELE1": "A1", "ALLELE_1": "A1", "EFFECT_ALLELE": "A1", "REFERENCE_ALLELE": "A1", "INC_ALLELE": "A1", "EA": "A1",
    "A2": "A2", "ALLELE2": "A2", "ALLELE_2": "A2", "OTHER_ALLELE": "A2", "NON_EFFECT_ALLELE": "A2", "DEC_ALLELE": "A2", "NEA": "A2",
    "N": "N", "WEIGHT": "N", "NCASE": "N_CAS", "CASES_N": "N_CAS", "N_CASE": "N_CAS", "N_CASES": "N_CAS", "N_CAS": "N_CAS",
    "N_CONTROLS": "N_CON", "N_CON": "N_CON", "NCONTROL": "N_CON", "CONTROLS_N": "N_CON", "N_CONTROL": "N_CON",
    "ZSCORE": "Z", "Z_SCORE": "Z", "GC_ZSCORE": "Z", "Z": "Z", "OR": "OR", "B": "BETA", "BETA": "BETA", "EFFECTS": "BETA", "EFFECT": "BETA",
    "LOG_ODDS": "LOG_ODDS", "SIGNED_SUMSTAT": "SIGNED_SUMSTAT", "INFO": "INFO",
    "EAF": "FRQ", "FRQ": "FRQ", "MAF": "FRQ", "FRQ_U": "FRQ", "F_U": "FRQ",
}
NULL_EFFECT = {"Z": 0.0, "OR": 1.0, "BETA": 0.0, "LOG_ODDS": 0.0, "SIGNED_SUMSTAT": 0.0}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def resolve_headers(names: list[str], overrides: dict[str, str] | None = None, ignore: tuple[str, ...] = ()) -> dict[str, str]:
    """File header -> canonical field; ignored names first, then overrides, then aliases. Two headers for one field are an error."""

    def tidy(x: str) -> str:
        return x.upper().replace("-", "_").replace(".", "_").replace("\n", "")

    own = {tidy(k): v for k, v in (overrides or {}).items()}
    skip = {tidy(x) for x in ignore}
    out = {n: own.get(tidy(n)) or ALIASES.get(tidy(n)) for n in names if tidy(n) not in skip}
    out = {n: f for n, f in out.items() if f}
    twice = sorted({f for f in out.values() if list(out.values()).count(f) > 1})
    if twice:
        raise ValueError(f"several headers for {', '.join(twice)}")
    return out


def alleles(a1: Column, a2: Column) -> Column:
    return F.concat(F.upper(a1), F.upper(a2))


def _pairs() -> list[str]:
    """Pairs of different bases that aren't each other's complement."""
    return [x + y for x in COMPLEMENT for y in COMPLEMENT if x != y and COMPLEMENT[x] != y]


def allele_table() -> list[tuple[str, bool]]:
    """Four alleles of two studies -> whether the second is flipped; only pairs that match, on either strand."""
    out = []
    for p in _pairs():
        other = COMPLEMENT[p[0]] + COMPLEMENT[p[1]]
        out += [(p + p, False), (p + other, False), (p + p[::-1], True), (p + other[::-1], True)]
    return out


def unambiguous(a1: Column, a2: Column) -> Column:
    return alleles(a1, a2).isin(_pairs())


def clean(raw: DataFrame, info_min: float = 0.9, maf_min: float = 0.01, keep_order: str | None = None) -> tuple[DataFrame, Column]:
    """Rows that pass, and the reason expression (null: passes) in the order in which filters apply.

    Columns as resolved: SNP, P and, where present, INFO, FRQ, A1, A2. A null in any other column than INFO fails.
    """
    cols = raw.columns
    need = [c for c in ("SNP", "P", "A1", "A2", "N", "Z", "OR", "BETA", "LOG_ODDS", "FRQ") if c in cols]
    reason = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in need], F.lit(0)) == 1, "missing")
    reason = reason.when((F.col("P") <= 0) | (F.col("P") > 1), "p") if "P" in cols else reason
    reason = reason.when(F.col("INFO") < info_min, "info") if "INFO" in cols else reason
    if "FRQ" in cols:
        reason = reason.when((F.col("FRQ") < 0) | (F.col("FRQ") > 1) | (F.least("FRQ", 1 - F.col("FRQ")) <= maf_min), "frq")
    reason = reason.when(~unambiguous(F.col("A1"), F.col("A2")), "alleles") if "A1" in cols else reason
    return raw.filter(reason.isNull()), reason


def drop_counts(raw: DataFrame, reason: Column) -> DataFrame:
    return raw.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least order for each key."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_x")).select(key, "_x.*").select(df.columns)


def effective_n(df: DataFrame, cases: str = "N_CAS", controls: str = "N_CON") -> DataFrame:
    """N scaled by each row's case share against the mean share of the rows with the most samples."""
    n = F.col(cases) + F.col(controls)
    share = F.col(cases) / n
    top = df.agg(F.max(n).alias("_top"))
    mean = df.join(F.broadcast(top)).filter(n == F.col("_top")).agg(F.avg(share).alias("_p"))
    return df.join(F.broadcast(mean)).withColumn("N", n * share / F.col("_p")).drop("_p")


def enough_n(df: DataFrame, n_min: float | None = None) -> DataFrame:
    """Rows with at least n_min samples, or the 90th percentile / 1.5."""
    if n_min is not None:
        return df.filter(F.col("N") >= n_min)
    q = df.agg((F.percentile("N", F.lit(0.9)) / 1.5).alias("_q"))
    return df.join(F.broadcast(q)).filter(F.col("N") >= F.col("_q")).drop("_q")


def z_scores(df: DataFrame, effect: str) -> DataFrame:
    """Z from P, signed by the effect against its null value."""

    def z(p: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt([special.chi2_isf_1(x) for x in p]), dtype=float)

    size = F.pandas_udf(z, "double")("P")
    return df.withColumn("Z", size * F.when(F.col(effect) < NULL_EFFECT.get(effect, 0.0), -1.0).otherwise(1.0))


def median_is(df: DataFrame, column: str, expected: float, within: float = 0.1) -> bool:
    m = df.agg(F.median(column)).first()[0]
    return m is not None and abs(m - expected) <= within


def merge_alleles(reference: DataFrame, stats: DataFrame) -> DataFrame:
    """reference (SNP, A1, A2) left-joined with stats; where the alleles don't match, the statistics are null."""
    ref = reference.select("SNP", alleles(F.col("A1"), F.col("A2")).alias("_ma"))
    spark = reference.sparkSession
    ok = F.broadcast(spark.createDataFrame([(k, True) for k, _ in allele_table()], "_key string, _ok boolean"))
    out = ref.join(stats, "SNP", "left").withColumn("_key", F.concat(alleles(F.col("A1"), F.col("A2")), "_ma")).join(ok, "_key", "left")
    rest = [c for c in stats.columns if c != "SNP"]
    return out.select("SNP", *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in rest])


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both studies with matching alleles; z2 has b's sign turned where its alleles are."""
    spark = a.sparkSession
    table = F.broadcast(spark.createDataFrame(allele_table(), "_key string, _flip boolean"))
    x = b.select("SNP", F.col("A1").alias("A1x"), F.col("A2").alias("A2x"), F.col("Z").alias("_z"), F.col("N").alias("N2"))
    out = a.join(x, "SNP").withColumn("_key", F.concat(alleles(F.col("A1"), F.col("A2")), alleles(F.col("A1x"), F.col("A2x")))).join(table, "_key")
    return out.withColumn("Z2", F.when(F.col("_flip"), -F.col("_z")).otherwise(F.col("_z"))).drop("_key", "_flip", "_z", "A1x", "A2x")


def summary(stats: DataFrame) -> DataFrame:
    c = F.col("Z") * F.col("Z")
    return stats.agg(F.avg(c).alias("mean_chi2"), (F.median(c) / 0.4549).alias("lambda_gc"), F.max(c).alias("max_chi2"), F.count_if(c > 29).alias("n_significant"))


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose sample variance isn't zero."""
    v = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if v[c]]


# --- regression -------------------------------------------------------------------------------------


def with_blocks(df: DataFrame, order: list[str], blocks: int, total: int | None = None) -> DataFrame:
    """Block ids by evenly spaced separators floor(i n / blocks) in genome order; numbered in two levels by chromosome."""
    keys, rest = order[:1], order[1:]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(*keys)) - F.col("_n")).drop("_n")
    n = total or df.count()
    b = min(blocks, n)
    i = F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(*rest)) - 1
    out = df.join(F.broadcast(sizes), keys).withColumn("_i", i)
    # The last separator at or below i: floor(k n / b) <= i.
    return out.withColumn("block", F.floor(((F.col("_i") + 1) * b - 1) / n).cast("int")).drop("_i", "_before")


def block_sums(df: DataFrame, y: str, xs: list[str], weight: Column | None = None) -> DataFrame:
    """Per block: sums of w x_i x_j and w x_i y, in which weighted regression and its jackknife are exact."""
    w = F.lit(1.0) if weight is None else weight
    aggs = [F.sum(w * F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    aggs += [F.sum(w * F.col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(xs)]
    return df.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *aggs)


def _matrices(sums: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    xx = np.zeros((len(sums), k, k))
    for i in range(k):
        for j in range(i, k):
            xx[:, i, j] = xx[:, j, i] = sums[f"xx_{i}_{j}"]
    return xx, sums[[f"xy_{i}" for i in range(k)]].to_numpy()


def jackknife(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, covariance, delete-one estimates) from the blocks' sums."""
    sx, sy = xx.sum(0), xy.sum(0)
    est = np.linalg.solve(sx, sy)
    deleted = np.array([np.linalg.solve(sx - a, sy - b) for a, b in zip(xx, xy, strict=True)])
    return (est, *_jackknifed(est, deleted))


def _jackknifed(est: np.ndarray, deleted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(deleted)
    pseudo = n * est - (n - 1) * deleted
    return np.atleast_2d(np.cov(pseudo.T, ddof=1)) / n, deleted


def ratio_jackknife(est: float, numerator: np.ndarray, denominator: np.ndarray) -> tuple[float, float]:
    """(estimate, standard error) of a ratio from delete-one values."""
    n = len(numerator)
    pseudo = n * est - (n - 1) * numerator / denominator
    return float(pseudo.mean()), float(math.sqrt(pseudo.var(ddof=1) / n))


def nnls(xx: np.ndarray, xy: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares on normal equations, by coordinate descent."""
    b = np.zeros(len(xy))
    for _ in range(rounds):
        old = b.copy()
        for i in range(len(b)):
            if xx[i, i] > 0:
                b[i] = max(0.0, b[i] + (xy[i] - xx[i] @ b) / xx[i, i])
        if np.abs(b - old).max() < 1e-12:
            break
    return b


def nnls_active(a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that minimises x'ax/2 - b'x, by active sets; start: which x are thought to be positive, which saves steps where it is nearly right.

    Variables enter by the largest gradient and leave where a step would make them negative, until no gradient is above zero.
    """
    k = len(b)
    free = np.zeros(k, bool) if start is None else start.copy()
    x, tol = np.zeros(k), 1e-12 * max(1.0, float(np.abs(b).max(initial=0)))

    def settle() -> None:
        nonlocal x
        while free.any():
            full = np.zeros(k)
            full[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            if (full[free] > 0).all():
                x = full
                return
            out = free & (full <= 0)
            step = np.min(x[out] / np.maximum(x[out] - full[out], 1e-300))
            x = np.where(free, x + step * (full - x), 0.0)
            free[out & (x <= 1e-15 * max(1.0, np.abs(x).max()))] = False
            x[~free] = 0.0
        x = np.zeros(k)

    settle()
    for _ in range(10 * k + 10):
        gradient = np.where(free, -np.inf, b - a @ x)
        i = int(np.argmax(gradient))
        if gradient[i] <= tol:
            break
        free[i] = True
        settle()
    return x


def jackknife_nonnegative(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As jackknife(), of the non-negative solution: each block is left out and the system solved again, from the active set of the whole."""
    sx, sy = xx.sum(0), xy.sum(0)
    est = nnls_active(sx, sy)
    deleted = np.array([nnls_active(sx - a, sy - b, est > 0) for a, b in zip(xx, xy, strict=True)])
    return (est, *_jackknifed(est, deleted))


def _h2_weight(h2: Column | float, intercept: Column | float, m: float) -> Column:
    ld = F.greatest(F.col("ld"), F.lit(1.0))
    h = max(0.0, min(1.0, float(h2)))
    het = 1 / (2 * (F.lit(float(intercept)) + F.lit(h / m) * F.col("N") * ld) ** 2)
    return het / F.greatest(F.col("w_ld"), F.lit(1.0))


def heritability(snps: DataFrame, ld_columns: list[str], m: list[float], blocks: int = 200, intercept: float | None = None, two_step: float | None = None, chi2_max: float | None = None, order: list[str] | None = None) -> dict:
    """snps (CHR, BP, Z, N, w_ld, LD scores) -> estimates by weighted regression of Z^2 on N ld / mean N, twice reweighted.

    Each round is one aggregation to sums of products per block; the driver solves systems as large as the annotations.
    """
    xs = [f"x{i}" for i in range(len(ld_columns))]
    df = snps.withColumn("chi2", F.col("Z") * F.col("Z")).withColumn("ld", sum((F.col(c) for c in ld_columns), F.lit(0.0)))
    limit = chi2_max if chi2_max is not None else (max(0.001 * (df.agg(F.max("N")).first()[0] or 0), 80.0) if len(ld_columns) > 1 else None)
    df = df.filter(F.col("chi2") < limit) if limit is not None else df
    n_bar = df.agg(F.avg("N")).first()[0]
    df = df.withColumns({x: F.col("N") * F.col(c) / n_bar for x, c in zip(xs, ld_columns, strict=True)})
    df = with_blocks(df, order or ["CHR", "BP", "SNP"], blocks).cache()
    total_m = float(sum(m))
    fixed = intercept
    s = df.agg(F.avg("chi2").alias("y"), F.avg(F.col("ld") * F.col("N")).alias("x")).first()
    h2 = total_m * (s["y"] - (1.0 if fixed is None else fixed)) / s["x"]

    def fit(rows: DataFrame, inter: float | None, h2_: float, rounds: int = 2):
        a = 1.0 if inter is None else inter
        cols = xs if inter is not None else [*xs, "_one"]
        rows = rows.withColumn("_one", F.lit(1.0)).withColumn("_y", F.col("chi2") - (0.0 if inter is None else inter))
        for k in range(rounds + 1):
            sums = block_sums(rows, "_y", [*xs, "_one"], _h2_weight(h2_, a, total_m)).orderBy("block").toPandas()
            whole, xy = _matrices(sums, len(xs) + 1)
            xx, xy = whole[:, : len(cols), : len(cols)], xy[:, : len(cols)]
            if k == rounds:
                one = whole.sum(0)[: len(xs), -1]
                return (*jackknife(xx, xy), np.linalg.solve(whole.sum(0)[: len(xs), : len(xs)], one))
            est = np.linalg.solve(xx.sum(0), xy.sum(0))
            h2_ = float((est[: len(xs)] * np.array(m)).sum() / n_bar)
            a = est[-1] if inter is None else inter
        return None

    if two_step is not None and fixed is None:
        first = fit(df.filter(F.col("chi2") < two_step), None, h2)
        step = first[0][-1]
        est, _, deleted, shift = fit(df, float(step), h2)
        if len(first[2]) != len(deleted):
            raise ValueError("a block holds no statistic below two_step; take fewer blocks")
        # A block's absence moves the intercept of the first step, and that the slopes of the second.
        cov, deleted = _jackknifed(est, deleted - np.outer(first[2][:, -1] - step, shift))
        inter, inter_se = float(step), float(math.sqrt(first[1][-1, -1]))
    else:
        est, cov, deleted, _ = fit(df, fixed, h2)
        inter, inter_se = (float(est[-1]), float(math.sqrt(cov[-1, -1]))) if fixed is None else (fixed, math.nan)
    k = len(xs)
    coef, mm = est[:k] / n_bar, np.array(m, float)
    cat = mm * coef
    cov_coef = cov[:k, :k] / n_bar**2
    tot = float(cat.sum())
    part = deleted[:, :k] / n_bar * mm
    prop = [ratio_jackknife(float(c / tot), part[:, i], part.sum(1)) for i, c in enumerate(cat)]
    return {
        "coef": coef.tolist(), "coef_se": np.sqrt(np.diag(cov_coef)).tolist(), "cat": cat.tolist(), "total": tot,
        "total_se": float(math.sqrt(mm @ cov_coef @ mm)), "prop": (cat / tot).tolist(), "prop_se": [p[1] for p in prop],
        "enrichment": ((cat / mm) / (tot / total_m)).tolist(), "intercept": inter, "intercept_se": inter_se,
        "mean_chi2": float(s["y"]), "ratio": (inter - 1) / (s["y"] - 1) if s["y"] > 1 else math.nan, "n_blocks": len(deleted),
        "deleted": deleted[:, :k].tolist(), "n_bar": float(n_bar), "coef_cov": cov_coef.tolist(),
    }


def genetic_correlation(snps: DataFrame, ld: str, m: float, blocks: int = 200, order: list[str] | None = None) -> dict:
    """snps (CHR, BP, Z, Z2, N, N2, w_ld, ld) -> both heritabilities, covariance, correlation with a ratio jackknife."""
    a = heritability(snps, [ld], [m], blocks, order=order)
    b = heritability(snps.withColumns({"Z": F.col("Z2"), "N": F.col("N2")}), [ld], [m], blocks, order=order)
    n12 = F.sqrt(F.col("N") * F.col("N2"))
    df = snps.withColumns({"_y": F.col("Z") * F.col("Z2"), "_n": n12}).withColumn("_one", F.lit(1.0))
    n_bar = df.agg(F.avg("_n")).first()[0]
    df = with_blocks(df.withColumn("_x", F.col("_n") * F.col(ld) / n_bar), order or ["CHR", "BP", "SNP"], blocks).cache()
    l_ = F.greatest(F.col(ld), F.lit(1.0))
    rho, inter = 0.0, 0.0
    for k in range(3):
        x = F.lit(max(0.0, min(1.0, a["total"])) / m) * F.col("N") * l_ + a["intercept"]
        y = F.lit(max(0.0, min(1.0, b["total"])) / m) * F.col("N2") * l_ + b["intercept"]
        z = F.lit(max(-1.0, min(1.0, rho)) / m) * F.col("_n") * l_ + inter
        sums = block_sums(df, "_y", ["_x", "_one"], 1 / (x * y + z * z) / F.greatest(F.col("w_ld"), F.lit(1.0))).orderBy("block").toPandas()
        xx, xy = _matrices(sums, 2)
        if k < 2:
            est = np.linalg.solve(xx.sum(0), xy.sum(0))
            rho, inter = float(est[0] * m / n_bar), float(est[1])
    est, cov, deleted = jackknife(xx, xy)
    cov_g = float(est[0] * m / n_bar)
    out = {"h2_1": a["total"], "h2_2": b["total"], "gencov": cov_g, "gencov_se": float(math.sqrt(cov[0, 0]) * m / n_bar), "intercept": float(est[1])}
    if a["total"] > 0 and b["total"] > 0:
        rg = cov_g / math.sqrt(a["total"] * b["total"])
        h1, h2 = (np.array(r["deleted"])[:, 0] * m / r["n_bar"] for r in (a, b))
        out["rg"], out["rg_se"] = rg, ratio_jackknife(rg, deleted[:, 0] * m / n_bar, np.sqrt(np.maximum(h1 * h2, 1e-300)))[1]
        out["p"] = special.chi2_sf((rg / out["rg_se"]) ** 2, 1) if out["rg_se"] > 0 else math.nan
    else:
        out |= {"rg": math.nan, "rg_se": math.nan, "p": math.nan}
    return out


def cell_types(snps: DataFrame, base: list[str], m_base: list[float], cells: dict[str, tuple[str, float]], blocks: int = 200) -> list[dict]:
    """For each cell type (column, m): coefficient, error and one-sided p beside the base annotations, in order of p."""
    out = []
    for name, (column, m) in cells.items():
        r = heritability(snps, [column, *base], [m, *m_base], blocks)
        z = r["coef"][0] / r["coef_se"][0] if r["coef_se"][0] > 0 else math.nan
        out.append({"name": name, "coef": r["coef"][0], "coef_se": r["coef_se"][0], "p": special.norm_sf(z) if z == z else math.nan})
    return sorted(out, key=lambda x: (x["p"] != x["p"], x["p"]))


def liability(h2: float, k: float, p: float) -> float:
    """Observed to liability scale; k: population, p: sample prevalence."""
    from statistics import NormalDist

    t = NormalDist().inv_cdf(1 - k)
    return h2 * k**2 * (1 - k) ** 2 / (p * (1 - p) * NormalDist().pdf(t) ** 2)


def overlap_matrix(annot: DataFrame, columns: list[str]) -> np.ndarray:
    """A^T A of annotation columns."""
    row = annot.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    out = np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            out[i, j] = out[j, i] = row[f"{i}_{j}"] or 0
    return out


def overlapping_categories(result: dict, overlap: np.ndarray, m: list[float], m_total: float) -> list[dict]:
    """Proportions and enrichments of categories that overlap, p by a t distribution on the number of blocks."""
    mm = np.array(m, float)
    coef, cov = np.array(result["coef"]), np.array(result["coef_cov"])
    cat = overlap @ coef
    cat_cov = overlap @ cov @ overlap.T
    prop = cat / result["total"]
    out = []
    for i in range(len(m)):
        rest = m_total - mm[i]
        diff = overlap[i] / mm[i] - (mm - overlap[i]) / rest if rest > 0 else None
        est = float(diff @ coef) if diff is not None else math.nan
        se = math.sqrt(max(float(diff @ cov @ diff), 0.0)) if diff is not None else math.nan
        p = 2 * special.t_sf(abs(est / se), result["n_blocks"]) if se and se == se else math.nan
        out.append({"prop_snps": mm[i] / m_total, "prop_h2": float(prop[i]), "prop_h2_se": math.sqrt(max(cat_cov[i, i], 0.0)) / abs(result["total"]), "enrichment": float(prop[i] / (mm[i] / m_total)), "p": p})
    return out


# --- LD scores ---------------------------------------------------------------------------------------


def standardise(g: np.ndarray, missing: int = 9) -> np.ndarray:
    """Genotypes with missing ones at the mean, mean 0 and population deviation 1 (or 0 if they don't vary)."""
    x = g.astype(float)
    gap = x == missing
    x[gap] = np.nan
    mean = np.nanmean(x) if (~gap).any() else 0.0
    x = np.where(gap, mean, x) - mean
    sd = x.std()
    return x / (sd or 1.0)


def maf(g: Column) -> Column:
    """Minor allele frequency of an array of genotypes (9: missing)."""
    known = F.filter(g, lambda x: x != 9)
    f = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / (2.0 * F.size(known))
    return F.least(f, 1 - f)


def keep_snps(genotypes: DataFrame, maf_min: float = 0.0) -> DataFrame:
    """Without monomorphic SNPs and those at or below maf_min."""
    return genotypes.withColumn("maf", maf(F.col("genotypes"))).filter(F.col("maf") > maf_min)


def restrict(genotypes: DataFrame, snps: DataFrame | None = None, people: list[int] | None = None) -> DataFrame:
    """Only the listed SNPs (SNP), and only the listed individuals' places in the genotypes, in this order."""
    out = genotypes if snps is None else genotypes.join(snps.select("SNP").distinct(), "SNP", "left_semi")
    if people is None:
        return out
    return out.withColumn("genotypes", F.transform(F.array(*[F.lit(i) for i in people]).cast("array<int>"), lambda i: F.get("genotypes", i)))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, mean, std, min, the quartiles and max of each column, in one pass; nulls are left out."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "q25": lambda c: F.percentile(c, F.lit(0.25)), "q50": lambda c: F.percentile(c, F.lit(0.5)), "q75": lambda c: F.percentile(c, F.lit(0.75)), "max": F.max}
    row = df.agg(*[F.struct(*[f(F.col(c).cast("double")).alias(k) for k, f in stats.items()]).alias(f"_{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}.{k}").alias(k) for k in stats]) for i, c in enumerate(columns)])
    return row.select(F.explode(each).alias("x")).select("x.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every two columns, both orders and each with itself, from one aggregation; null where a column doesn't vary."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.corr(columns[i], columns[j]).alias(f"_{i}_{j}") for i, j in pairs])
    each = [(i, j, k) for i, j in pairs for k in ({(i, j), (j, i)})]
    return row.select(F.explode(F.array(*[F.struct(F.lit(columns[a]).alias("a"), F.lit(columns[b]).alias("b"), F.col(f"_{i}_{j}").alias("r")) for i, j, (a, b) in each])).alias("x")).select("x.*")


def condition_number(df: DataFrame, columns: list[str]) -> float:
    """Of the matrix of these columns, from their sums of products."""
    s = np.linalg.svd(overlap_matrix(df, columns), compute_uv=False)
    return math.sqrt(s[0] / s[-1]) if s[-1] > 0 else math.inf


def ld_scores(genotypes: DataFrame, window: float, coordinate: str = "BP", annotations: list[str] | None = None, per_allele: float | None = None, block: float | None = None) -> DataFrame:
    """genotypes (CHR, SNP, BP, coordinate, genotypes, annotations) -> SNP, L2 per annotation: sums of unbiased r^2 within the window.

    The genome is cut into blocks of the coordinate; each task holds a block and its halo of one window and returns
    scores of the block's own SNPs. per_allele: weights (p q)^s.
    """
    names = annotations or ["L2"]
    step = block or max(window * 4, 1.0)
    c = F.col(coordinate)
    df = genotypes if annotations else genotypes.withColumn("L2", F.lit(1.0))
    if per_allele is not None:
        f = maf(F.col("genotypes"))
        df = df.withColumns({a: F.col(a) * F.pow(f * (1 - f), F.lit(per_allele)) for a in names})
    at = F.explode(F.sequence(F.floor((c - window) / step), F.floor((c + window) / step)))
    df = df.select("CHR", "SNP", c.cast("double").alias("_c"), "genotypes", *[F.col(a).cast("double") for a in names], at.alias("_block"))
    schema = "CHR int, SNP string, " + ", ".join(f"`{a}` double" for a in names)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_c", "SNP"])
        x = np.stack([standardise(np.asarray(g)) for g in pdf["genotypes"]])
        pos, n = pdf["_c"].to_numpy(), x.shape[1]
        a = pdf[names].to_numpy(float)
        own = np.flatnonzero(np.floor(pos / step) == pdf["_block"].iloc[0])
        lo, hi = np.searchsorted(pos, pos[own] - window, "left"), np.searchsorted(pos, pos[own] + window, "right")
        out = np.zeros((len(own), len(names)))
        for k, (i, b, e) in enumerate(zip(own, lo, hi, strict=True)):
            r2 = (x[b:e] @ x[i] / n) ** 2
            out[k] = (r2 - (1 - r2) / max(n - 2, 1)) @ a[b:e]
        res = pd.DataFrame(out, columns=names)
        res.insert(0, "SNP", pdf["SNP"].to_numpy()[own])
        res.insert(0, "CHR", pdf["CHR"].to_numpy()[own])
        return res

    return df.groupBy("CHR", "_block").applyInPandas(score, schema)


def m_counts(annot: DataFrame, names: list[str], frequency: str = "maf", above: float = 0.05) -> DataFrame:
    """Sums of annotations over all SNPs (m) and over those above a frequency (m_5_50)."""
    cols = [F.sum(a).alias(f"m_{a}") for a in names] + [F.sum(F.when(F.col(frequency) > above, F.col(a)).otherwise(0)).alias(f"m_5_50_{a}") for a in names]
    return annot.agg(*cols)


def continuous_bins(df: DataFrame, columns: dict[str, list[float]]) -> DataFrame:
    """One annotation per cell of the full product of cuts: columns -> break points; values in (a, b]."""
    cell = []
    for c, cuts in columns.items():
        x = F.lit(0)
        for v in cuts:
            x = x + (F.col(c) > v).cast("int")
        cell.append(x.cast("string"))
    out = df.withColumn("cell", F.concat_ws("_", *cell))
    levels = [""]
    for cuts in columns.values():
        levels = [f"{p}_{i}" if p else str(i) for p in levels for i in range(len(cuts) + 1)]
    return out.select(*df.columns, *[(F.col("cell") == v).cast("int").alias(f"cell_{v}") for v in levels])


def quantile_cuts(df: DataFrame, column: str, bins: int) -> list[float]:
    """Nearest-rank cut points sorted[round(i (n-1) / bins)], the first lowered by 1e-10.

    Ranks are found from counts of distinct values, numbered in order.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("k"))
    cum = counts.withColumn("_to", F.sum("k").over(Window.orderBy(column))).withColumn("_from", F.col("_to") - F.col("k"))
    n = df.filter(F.col(column).isNotNull()).count()
    ranks = [math.floor(i * (n - 1) / bins + 0.5) for i in range(bins + 1)]
    cuts = []
    for r in ranks:
        cuts.append(F.min(F.when((F.col("_from") <= r) & (F.col("_to") > r), F.col(column))))
    row = cum.agg(*[c.alias(f"c{i}") for i, c in enumerate(cuts)]).first()
    out = [float(x) for x in row]
    return [out[0] - 1e-10, *out[1:]]


def quantile_sums(df: DataFrame, column: str, annotations: list[str], bins: int = 5) -> DataFrame:
    """Sums of annotations by quantile bin (cut_q < v <= cut_q+1) of a continuous one."""
    cuts = quantile_cuts(df, column, bins)
    q = None
    for i in range(bins):
        cond = (F.col(column) > cuts[i]) & (F.col(column) <= cuts[i + 1])
        q = F.when(cond, i) if q is None else q.when(cond, i)
    return df.withColumn("q", q).filter("q is not null").groupBy("q").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in annotations])


def quantile_heritability(sums: np.ndarray, result: dict) -> list[dict]:
    """Heritability of each quantile and its error: sums (quantile x annotation) times the coefficients, by jackknife."""
    coef, deleted = np.array(result["coef"]), np.array(result["deleted"]) / result["n_bar"]
    out = []
    for row in sums:
        est, each = float(row @ coef), deleted @ row
        n = len(each)
        pseudo = n * est - (n - 1) * each
        out.append({"h2": est, "h2_se": float(math.sqrt(pseudo.var(ddof=1) / n)), "prop": est / result["total"]})
    return out


def snp_annotation(snps: DataFrame, bed: DataFrame, base: int = 1) -> DataFrame:
    """snps (CHR, SNP, BP) with annot = 1 inside the merged bed; base: a SNP covers [BP - base, BP - base + 1)."""
    from .intervals import merge, overlapping

    points = snps.withColumns({"chrom": F.concat(F.lit("chr"), F.col("CHR").cast("string")), "start": F.col("BP").cast("long") - base})
    points = points.withColumn("end", F.col("start") + 1)
    hit = overlapping(points.select("chrom", "start", "end", "SNP"), merge(bed)).select("SNP").distinct().withColumn("annot", F.lit(1))
    return snps.join(hit, "SNP", "left").fillna(0, ["annot"])


def many_annotations(snps: DataFrame, beds: DataFrame, names: list[str], more_than: int = 100) -> DataFrame:
    """A column per bed (beds: name and intervals) that more than that many SNPs hit; snps as in snp_annotation()."""
    from .intervals import overlap_join

    points = snps.withColumns({"chrom": F.concat(F.lit("chr"), F.col("CHR").cast("string")), "start": F.col("BP").cast("long")})
    points = points.withColumn("end", F.col("start") + 1)
    hits = overlap_join(points.select("chrom", "start", "end", "SNP"), beds.select("chrom", "start", "end", "name")).select("SNP", F.col("name_b").alias("name"))
    enough = hits.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than).select("name")
    wide = hits.distinct().join(F.broadcast(enough), "name").groupBy("SNP").pivot("name", names).agg(F.lit(1))
    return snps.join(wide, "SNP", "left").fillna(0, names)


def gene_windows(coordinates: DataFrame, genes: DataFrame, window: int) -> DataFrame:
    """Merged windows around the genes of a set: [max(1, start - window), end + window)."""
    from .intervals import merge

    rows = coordinates.join(genes.select("gene").distinct(), "gene")
    return merge(rows.withColumns({"start": F.greatest(F.lit(1), F.col("start") - window), "end": F.col("end") + window}))


def wide_results(results: DataFrame, trait: str = "trait", category: str = "category", value: str = "enrichment") -> DataFrame:
    """Category by trait, and Bonferroni-like q by the number of rows in results."""
    return results.groupBy(category).pivot(trait).agg(F.first(value))


def bonferroni(df: DataFrame, p: str) -> DataFrame:
    n = df.count()
    return df.withColumn("q", F.col(p) * n)
