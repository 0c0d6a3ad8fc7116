"""Survival: follow-up times, Kaplan-Meier, log-rank, univariate Cox models, cut-points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import columns as fc
from ..functions import ordered, special


def follow_up(rows: DataFrame, alive: str, last_seen: str, death: str, missing: str = "'--") -> DataFrame:
    """rows with tte (days to death or last follow-up; least value 1) and dead; rows without a time go."""
    days = F.when(F.col(alive), F.col(last_seen)).otherwise(F.col(death))
    out = rows.withColumn("tte", F.nullif(days.cast("string"), F.lit(missing)).try_cast("double")).filter("tte is not null")
    low = out.agg(F.min("tte").alias("_low"))
    return out.join(F.broadcast(low)).withColumn("tte", F.col("tte") - F.col("_low") + 1).withColumn("dead", ~F.col(alive)).drop("_low")


def at_risk(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per key and time: deaths d, and the number n at risk."""
    t = rows.groupBy(*by, "tte").agg(F.sum(F.col("dead").cast("int")).alias("d"), F.count(F.lit(1)).alias("k"))
    later = Window.partitionBy(*by).orderBy(F.desc("tte")).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("n", F.sum("k").over(later)).drop("k")


def kaplan_meier(rows: DataFrame, by: list[str]) -> DataFrame:
    """Survival after each time with a death: the product of 1 - d / n."""
    t = at_risk(rows, by).filter("d > 0")
    till = Window.partitionBy(*by).orderBy("tte").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max((F.col("d") == F.col("n")).cast("int")).over(till) == 1
    log = F.sum(F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)).over(till)
    return t.withColumn("survival", F.when(gone, 0.0).otherwise(F.exp(log)))


def log_rank(rows: DataFrame, group: str) -> DataFrame:
    """Two groups (boolean): observed and expected deaths of the true one, variance, chi-square."""
    t = rows.groupBy("tte").agg(F.sum(F.col("dead").cast("int")).alias("d"), F.count(F.lit(1)).alias("k"), F.sum((F.col("dead") & F.col(group)).cast("int")).alias("d1"), F.sum(F.col(group).cast("int")).alias("k1"))
    later = Window.orderBy(F.desc("tte")).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct day
    t = t.withColumns({"n": F.sum("k").over(later), "n1": F.sum("k1").over(later)}).filter("d > 0")
    e = F.col("d") * F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, e * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    out = t.agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    return out.withColumn("chi2", (F.col("observed") - F.col("expected")) ** 2 / F.col("variance"))


def cox_fit(x: np.ndarray, tte: np.ndarray, dead: np.ndarray, penalty: float = 1e-6) -> tuple[float, float]:
    """(coefficient, Wald p) of one standardised covariate by Newton on Breslow's partial likelihood; (0, 1) if it fails."""
    sd = x.std()
    if not len(x) or sd == 0 or not dead.any():
        return 0.0, 1.0
    z = (x - x.mean()) / sd
    order = np.argsort(-tte, kind="stable")
    z, tte, dead = z[order], tte[order], dead[order]
    last = np.searchsorted(-tte, -tte, side="right") - 1  # ties are at risk together
    b = 0.0
    for _ in range(50):
        w = np.exp(np.clip(b * z, -50, 50))
        s0, s1, s2 = (np.cumsum(w * z**k)[last] for k in range(3))
        m = s1 / s0
        g = (dead * (z - m)).sum() - penalty * b
        h = (dead * (s2 / s0 - m * m)).sum() + penalty
        step = g / h if h > 0 else math.nan
        if not math.isfinite(step):
            return 0.0, 1.0
        b += max(-2.0, min(2.0, step))
        if abs(step) < 1e-9:
            return b / sd, 2 * special.norm_sf(abs(b) * math.sqrt(h))
    return 0.0, 1.0


def cox_univariate(values: DataFrame, times: DataFrame, min_samples: int = 20, min_deaths: int = 3, penalty: float = 1e-6) -> DataFrame:
    """values (feature, sample, value), times (sample, tte, dead): coefficient, hazard ratio, p, q, sign by feature.

    The fits are those of cox_fit(), as rounds over all features at once: a round sums the rows by feature and time before it
    orders them, so neither the times nor a feature's samples have to be in one place. A cohort too small gives no rows.
    """
    spark = values.sparkSession
    size = times.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dead").cast("int")).alias("d")).first()
    rows = values.select("feature", "sample", F.col("value").cast("double")).join(times.select("sample", F.col("tte").cast("double"), F.col("dead").cast("int").alias("d")), "sample").drop("sample")
    if size["n"] <= min_samples or (size["d"] or 0) <= min_deaths:
        rows = rows.limit(0)
    rows, rows_path = session.stored(rows)
    stats = rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.sum("d").alias("deaths"), F.count_if(F.col("value").isNull()).alias("none"))
    fails = (F.col("none") > 0) | F.col("sd").isNull() | F.isnan("sd") | (F.col("sd") == 0) | (F.col("deaths") == 0)
    state, path = session.stored(stats.select("feature", "mean", "sd", F.lit(0.0).alias("b"), F.lit(1.0).alias("p"), fails.alias("failed"), fails.alias("done")))
    for _ in range(50):
        left = state.filter("not done")
        if left.isEmpty():
            break
        now = ordered.join_on(rows, left.select("feature", "mean", "sd", "b"), ["feature"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd"))
        w = F.exp(F.least(F.greatest(F.col("b") * F.col("z"), F.lit(-50.0)), F.lit(50.0)))
        each = now.groupBy("feature", "tte").agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col("z")).alias("zd"), *[F.sum(w * F.col("z") ** k).alias(f"w{k}") for k in range(3)])
        later = Window.partitionBy("feature").orderBy(F.desc("tte")).rowsBetween(Window.unboundedPreceding, 0)
        each = each.select("feature", "d", "zd", *[F.sum(f"w{k}").over(later).alias(f"s{k}") for k in range(3)])
        mean = F.col("s1") / F.col("s0")
        sums = each.groupBy("feature").agg(F.sum(F.col("zd") - F.col("d") * mean).alias("g"), F.sum(F.col("d") * (F.col("s2") / F.col("s0") - mean * mean)).alias("h"))
        step = F.when(F.col("h") + penalty > 0, (F.col("g") - penalty * F.col("b")) / (F.col("h") + penalty))
        told = ordered.join_on(state, sums, ["feature"], "left").withColumn("step", step)
        lost = ~F.col("done") & (F.col("step").isNull() | F.isnan("step") | (F.abs("step") == float("inf")))
        near = F.coalesce(F.abs(F.col("step")) < 1e-9, F.lit(False))
        to = F.when(F.col("done") | lost, F.col("b")).otherwise(F.col("b") + F.least(F.greatest(F.col("step"), F.lit(-2.0)), F.lit(2.0)))
        told = told.withColumns({"lost": lost, "near": near, "to": to})
        p = F.when(~F.col("done") & F.col("near"), 2 * fc.norm_p(F.abs("to") * F.sqrt(F.col("h") + penalty))).otherwise(F.col("p"))
        last = path
        state, path = session.stored(told.select("feature", "mean", "sd", F.col("to").alias("b"), p.alias("p"), (F.col("failed") | F.col("lost")).alias("failed"), (F.col("done") | F.col("lost") | F.col("near")).alias("done")))
        session.discard(spark, last)
    session.discard(spark, rows_path)
    bad = F.col("failed") | ~F.col("done")
    out = fc.bh(state.select("feature", F.when(bad, 0.0).otherwise(F.col("b") / F.col("sd")).alias("coef"), F.when(bad, 1.0).otherwise(F.col("p")).alias("p")), "p")
    return out.withColumns({"hazard_ratio": F.exp("coef"), "prognostic": F.when(F.col("q") < 0.05, F.signum("coef")).otherwise(0.0)})


def cox_terms(values: DataFrame, times: DataFrame, beta: float | DataFrame = 0.0) -> DataFrame:
    """Breslow's partial likelihood of each feature at a coefficient (one for all, or a table feature, coef): its slope (score) and curvature (information).

    values (feature, sample, value), times (sample, tte, dead), as for cox_univariate(). Rows are summed by time before they are
    ordered, so a feature's window has a row per distinct time. Features without a death have a score of 0.
    """
    rows = values.join(times, "sample")
    rows = rows.withColumn("_b", F.lit(float(beta))) if not isinstance(beta, DataFrame) else rows.join(beta.select("feature", F.col("coef").alias("_b")), "feature")
    v, w, d = F.col("value"), F.exp(F.col("_b") * F.col("value")), F.col("dead").cast("int")
    each = rows.groupBy("feature", "tte").agg(F.sum(d).alias("d"), F.sum(d * v).alias("vd"), F.sum(w).alias("w0"), F.sum(w * v).alias("w1"), F.sum(w * v * v).alias("w2"))
    later = Window.partitionBy("feature").orderBy(F.desc("tte")).rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("feature", "d", "vd", *[F.sum(f"w{k}").over(later).alias(f"s{k}") for k in range(3)])
    mean = F.col("s1") / F.col("s0")
    return each.groupBy("feature").agg(F.sum(F.col("vd") - F.col("d") * mean).alias("score"), F.sum(F.col("d") * (F.col("s2") / F.col("s0") - mean * mean)).alias("information"))


def best_cut(value: np.ndarray, tte: np.ndarray, dead: np.ndarray, perms: int = 1000, seed: int = 42, tails: float = 0.1) -> tuple[float, float, float]:
    """(cut, statistic, p): the cut of greatest standardised log-rank score, judged against shuffled values."""
    order = np.argsort(tte, kind="stable")
    value, tte, dead = value[order], tte[order], dead[order].astype(float)
    n = len(value)
    at = np.searchsorted(tte, tte, side="left")
    risk = n - at
    hazard = np.cumsum(dead / risk)[np.searchsorted(tte, tte, side="right") - 1]
    score = dead - hazard  # log-rank scores
    var = score.var(ddof=1)

    def highest(v: np.ndarray) -> tuple[float, float]:
        o = np.argsort(v, kind="stable")
        s, k = np.cumsum(score[o]), np.arange(1, n + 1)
        ok = (k >= max(1, int(tails * n))) & (k <= n - max(1, int(tails * n)))
        ok &= np.append(v[o][1:] != v[o][:-1], False)
        if not ok.any() or var <= 0:
            return math.nan, 0.0
        stat = np.abs(s - k * score.mean()) / np.sqrt(var * k * (n - k) / n + 1e-300)
        i = int(np.argmax(np.where(ok, stat, -1)))
        return float(v[o][i]), float(stat[i])

    cut, stat = highest(value)
    rng = np.random.default_rng(seed)
    null = [highest(rng.permutation(value))[1] for _ in range(perms)]
    return cut, stat, float((np.sum(np.array(null) >= stat) + 1) / (perms + 1))


def cut_points(values: DataFrame, times: DataFrame, perms: int = 1000) -> DataFrame:
    """Max-selected log-rank cut of each feature: cut, statistic, p."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, s, p = best_cut(pdf["value"].to_numpy(float), pdf["tte"].to_numpy(float), pdf["dead"].to_numpy(bool), perms)
        return pd.DataFrame({"feature": pdf["feature"].iloc[:1].to_numpy(), "cut": [c], "statistic": [s], "p": [p]})

    return values.join(F.broadcast(times), "sample").groupBy("feature").applyInPandas(run, f"feature {dict(values.dtypes)['feature']}, cut double, statistic double, p double")


def forest_table(results: DataFrame, feature) -> DataFrame:
    """results (cohort, feature, coef, p): one feature's rows over cohorts, strongest first."""
    return results.filter(F.col("feature") == feature).orderBy(F.desc(F.abs("coef")), "cohort")
