"""Two-group differences of counts: negative-binomial fits with dispersions shrunk to their trend, and Wald tests.

Features are dealt to lots, whose features go through every step at once. Work is in proportion to the counts above zero. Between the passes over the lots only the trend (two numbers) and its spread come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import columns as fc
from ..functions import special

LOW, HIGH = math.log(1e-8), math.log(1e3)
#: Size factors are one vector in each task; a matrix of more of them isn't one of samples.
MOST_SAMPLES = 1 << 20


class Group:
    """Samples of one group by their size factors s, as two sums over them that all features share: of ln(1 + s e^u) and of s e^u / (1 + s e^u).

    Both are smooth in u, and kept as Chebyshev series of 16 terms on intervals of length 1, which are exact to rounding. So a
    feature's zeros cost nothing: what they add to its likelihood depends on u = ln(level times dispersion) alone.
    """

    LOW, HIGH, TERMS = -46, 60, 16

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        m = self.TERMS
        angle = np.pi * (np.arange(m) + 0.5) / m
        turn = 2 / m * np.cos(np.outer(np.arange(m), angle))
        turn[0] /= 2
        u = np.arange(self.LOW, self.HIGH)[:, None] + (np.cos(angle) + 1) / 2
        logs, parts = np.zeros(u.shape), np.zeros(u.shape)
        s, times = np.unique(s, return_counts=True)
        for lo in range(0, len(s), 512):
            x = np.exp(u)[:, :, None] * s[lo : lo + 512]
            logs += np.log1p(x) @ times[lo : lo + 512]
            parts += (x / (1 + x)) @ times[lo : lo + 512]
        self.series = {"logs": logs @ turn.T, "parts": parts @ turn.T}

    def sums(self, name: str, u: np.ndarray) -> np.ndarray:
        u = np.clip(u, self.LOW, self.HIGH - 1e-9)
        at = np.floor(u)
        x = 2 * (u - at) - 1
        c = self.series[name][(at - self.LOW).astype(int)].T
        one, two = np.zeros_like(x), np.zeros_like(x)
        for k in range(self.TERMS - 1, 0, -1):
            one, two = c[k] + 2 * x * one - two, one
        return c[0] + x * one - two


class Counts:
    """The counts above zero of n features in one group: row (feature), s (the sample's size factor), k."""

    def __init__(self, group: Group, n: int, row: np.ndarray, s: np.ndarray, k: np.ndarray):
        self.group, self.n, self.row, self.s, self.k = group, n, row, s, k
        self.known = special.lgamma(k + 1.0)

    def add(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, self.n)

    def levels(self, alpha: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
        """The level q of mu = s q that is most likely at alpha, and its information about ln q."""
        q = np.maximum(self.add(self.k / self.s) / self.group.n, 1e-8)
        for _ in range(rounds):
            own = self.k / (1 + alpha[self.row] * self.s * q[self.row])
            info = self.group.sums("parts", np.log(q * alpha)) / alpha
            step = np.clip((self.add(own) - info) / np.maximum(info, 1e-300), -2, 2)
            q = np.maximum(q * np.exp(step), 1e-8)
            if np.abs(step).max(initial=0) < 1e-10:
                break
        return q, self.group.sums("parts", np.log(q * alpha)) / alpha


def _profile(counts: list[Counts], ln_alpha: np.ndarray) -> np.ndarray:
    """Log-likelihood of the dispersions with the levels at their best, less half the log of the levels' information."""
    a = np.exp(ln_alpha)
    r = 1 / a
    low = special.lgamma(r)
    out = np.zeros(len(a))
    for c in counts:
        q, info = c.levels(a, 8)
        mu, own = c.s * q[c.row], r[c.row]
        out += c.add(special.lgamma(c.k + own) - c.known - low[c.row] + c.k * (np.log(mu) - np.log(mu + own))) - r * c.group.sums("logs", np.log(q * a)) - 0.5 * np.log(info)
    return out


def _best(counts: list[Counts], n: int, prior: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """ln dispersions of highest profile likelihood (and prior: means and variance): a grid, then golden sections around its best."""

    def value(x: np.ndarray) -> np.ndarray:
        return _profile(counts, x) - (0 if prior is None else (x - prior[0]) ** 2 / (2 * prior[1]))

    grid = np.linspace(LOW, HIGH, 14)
    at = np.argmax([value(np.full(n, x)) for x in grid], axis=0)
    width = grid[1] - grid[0]
    lo, hi = grid[at] - width, grid[at] + width
    part = (math.sqrt(5) - 1) / 2
    x, y = hi - part * (hi - lo), lo + part * (hi - lo)
    fx, fy = value(x), value(y)
    for _ in range(16):
        left = fx > fy
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
        nx, ny = hi - part * (hi - lo), lo + part * (hi - lo)
        new = value(np.where(left, nx, ny))
        fx, fy = np.where(left, new, fy), np.where(left, fx, new)
        x, y = nx, ny
    return np.clip((lo + hi) / 2, LOW, HIGH)


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out, x = out + 1 / x**2, x + 1
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def wald(counts: DataFrame, samples: DataFrame, lot: int = 256, method: str = "bh") -> DataFrame:
    """counts (sample, feature, cnt; absent: 0), samples (sample, sf, treated: boolean) -> a test of each feature's treated level against the other.

    Dispersions are estimated for each feature, a trend a1 / mean + a0 is fitted to them, and they are estimated again with
    the trend as the centre of a normal prior on their logarithm; ln levels are Newton steps at these. log2_fc over its
    error is compared with the normal distribution. Features without a count are left out; rows of samples that are not
    listed too; counts of one sample and feature are summed. Both groups need two samples.
    Returns feature, mean, dispersion, trend, log2_fc, se, z, p, q.
    """
    spark = counts.sparkSession
    session.ship(spark)
    n = samples.count()
    if n > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    listed = samples.select("sample", F.col("sf").cast("double"), F.col("treated").cast("boolean")).orderBy("sample").toPandas()
    sf, treated = listed["sf"].to_numpy(), listed["treated"].to_numpy(bool)
    if min(treated.sum(), (~treated).sum()) < 2:
        raise ValueError("both groups need two samples")
    groups, kind = [Group(sf[~treated]), Group(sf[treated])], dict(counts.dtypes)["feature"]
    place = spark.createDataFrame(pd.DataFrame({"sample": listed["sample"], "at": np.arange(n)}))
    summed = counts.join(F.broadcast(place), "sample").groupBy("feature", "at").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0")  # at most MOST_SAMPLES rows
    rows, rows_path = session.stored(summed.groupBy("feature").agg(F.collect_list("at").alias("at"), F.collect_list("cnt").alias("cnt")))
    lots = max(1, -(-rows.count() // lot))
    rows = rows.withColumn("_lot", F.pmod(F.xxhash64("feature"), F.lit(lots)))

    def counted(pdf: pd.DataFrame) -> tuple[list[Counts], np.ndarray]:
        row = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["at"]])
        at, k = np.concatenate(pdf["at"].to_list()), np.concatenate(pdf["cnt"].to_list()).astype(float)
        out = []
        for g, which in zip(groups, (~treated, treated), strict=True):
            own = which[at]
            out.append(Counts(g, len(pdf), row[own], sf[at[own]], k[own]))
        return out, np.bincount(row, k / sf[at], len(pdf)) / n

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        c, mean = counted(pdf)
        return pd.DataFrame({"feature": pdf["feature"].to_numpy(), "mean": mean, "ln_alpha": _best(c, len(pdf))})

    own, path = session.stored(rows.groupBy("_lot").applyInPandas(first, f"feature {kind}, mean double, ln_alpha double"))
    told = own.withColumns({"a": F.exp("ln_alpha"), "x": 1 / F.col("mean")}).filter(F.col("ln_alpha") > LOW + 1)
    a0, a1 = (told.agg(F.percentile("a", F.lit(0.5))).first()[0] or 0.1), 0.0
    for _ in range(10):  # weights of a gamma error; far outliers of the last trend are left aside
        fit = F.lit(a0) + F.lit(a1) * F.col("x")
        w = F.when((F.col("a") / fit > 1e-4) & (F.col("a") / fit < 15), 1 / (fit * fit)).otherwise(0.0)
        s = told.agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("x"), F.sum(w * F.col("x") ** 2).alias("xx"), F.sum(w * F.col("a")).alias("y"), F.sum(w * F.col("x") * F.col("a")).alias("xy")).first()
        if not s["w"]:
            break
        det = s["w"] * s["xx"] - s["x"] ** 2
        b1 = max(0.0, (s["w"] * s["xy"] - s["x"] * s["y"]) / det) if det > 1e-12 * s["w"] * s["xx"] else 0.0
        b0 = max(1e-8, (s["y"] - b1 * s["x"]) / s["w"])
        done = abs(math.log(b0 / a0)) + abs(b1 - a1) / max(b1, 1e-8) < 1e-6
        a0, a1 = b0, b1
        if done:
            break
    off = told.select((F.col("ln_alpha") - F.log(F.lit(a0) + F.lit(a1) * F.col("x"))).alias("d"))
    middle = off.agg(F.percentile("d", F.lit(0.5)).alias("m"))
    spread = off.join(F.broadcast(middle)).agg(F.percentile(F.abs(F.col("d") - F.col("m")), F.lit(0.5))).first()[0]
    variance = max(0.25, (1.4826 * spread) ** 2 - _trigamma((n - 2) / 2)) if spread is not None else 1.0

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        c, mean = counted(pdf)
        trend = a0 + a1 / mean
        alpha = np.exp(_best(c, len(pdf), (np.log(trend), variance)))
        (q0, i0), (q1, i1) = (x.levels(alpha) for x in c)
        return pd.DataFrame({"feature": pdf["feature"].to_numpy(), "mean": mean, "dispersion": alpha, "trend": trend, "log2_fc": np.log2(q1 / q0), "se": np.sqrt(1 / i0 + 1 / i1) / math.log(2)})

    schema = f"feature {kind}, mean double, dispersion double, trend double, log2_fc double, se double"
    out, _ = session.stored(rows.groupBy("_lot").applyInPandas(second, schema))
    for x in (path, rows_path):
        session.discard(spark, x)
    out = out.withColumn("z", F.col("log2_fc") / F.col("se"))
    return fc.adjust(out.withColumn("p", 2 * fc.norm_p(F.abs("z"))), "p", method=method)
