"""Count matrices in long form (sample, feature, cnt; absent means zero): filters, size factors, residuals, tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import special


def detectable(counts: DataFrame, read_min: int = 1, exp_min: int = 2) -> DataFrame:
    """Features with at least read_min reads in at least exp_min samples."""
    return counts.groupBy("feature").agg(F.count_if(F.col("cnt") >= read_min).alias("n_samples")).filter(F.col("n_samples") >= exp_min)


def most_detected(counts: DataFrame, share: float = 0.05) -> DataFrame:
    """The int(share * features + 1) features that most samples detect: by samples above 0 reads, then above 1 to 4."""
    each = counts.groupBy("feature").agg(*[F.count_if(F.col("cnt") > k).alias(f"over{k}") for k in range(5)])
    n = int(share * each.count() + 1)
    return each.orderBy(*[F.desc(f"over{k}") for k in range(5)], "feature").limit(n)


def top_size_factors(counts: DataFrame, share: float = 0.05) -> DataFrame:
    """Reads in the most detected features, scaled to a mean of one."""
    top = counts.join(most_detected(counts, share).select("feature"), "feature", "left_semi")
    sums = top.groupBy("sample").agg(F.sum("cnt").alias("s"))
    return sums.select("sample", (F.col("s") / F.avg("s").over(Window.partitionBy(F.lit(0)))).alias("sf"))


def median_ratio_factors(counts: DataFrame, samples: int | None = None) -> DataFrame:
    """DESeq's size factors: the median over features without zeros of count / geometric mean."""
    n = samples or counts.select("sample").distinct().count()
    full = counts.filter("cnt > 0").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log("cnt")).alias("mean_log")).filter(F.col("n") == n)
    return counts.join(full, "feature").groupBy("sample").agg(F.median(F.col("cnt") / F.exp("mean_log")).alias("sf"))


def _ring_solution(pooled: np.ndarray, own: np.ndarray, size: int, weak: float = 1e-3) -> np.ndarray:
    """x whose sums over `size` neighbours of a ring come nearest to pooled, and x itself, with little weight, to own.

    Every pool is the last one turned by a place, so the equations' matrix is diagonal under a Fourier transform: n log n steps.
    """
    n = len(pooled)
    first = np.zeros(n)
    first[:size] = 1
    turn = np.conj(np.fft.fft(first))  # of the matrix whose row p has ones at p, p + 1, ...
    return np.fft.ifft((np.conj(turn) * np.fft.fft(pooled) + weak**2 * np.fft.fft(own)) / (np.abs(turn) ** 2 + weak**2)).real


def pooled_factors(counts: DataFrame, pool: int = 20) -> DataFrame:
    """Size factors deconvolved from pools of samples in a ring of library sizes (scran's scheme), scaled to mean one.

    A pool's factor is the median over features (of a mean count above 0.1) of its sum over the mean; features absent from a
    pool have ratio 0, and are counted rather than listed. Two numbers per sample come to the driver.
    """
    spark = counts.sparkSession
    lib = counts.groupBy("sample").agg(F.sum("cnt").alias("lib")).orderBy("lib", "sample").toPandas()
    n = len(lib)
    if n < 3:
        return spark.createDataFrame(lib.assign(sf=lib["lib"] / lib["lib"].mean())[["sample", "sf"]])
    ring = pd.concat([lib.iloc[::2], lib.iloc[1::2][::-1]], ignore_index=True)
    size = min(pool, n)
    place = spark.createDataFrame(pd.DataFrame({"sample": ring["sample"], "at": np.arange(n)}))
    mean = counts.groupBy("feature").agg((F.sum("cnt") / n).alias("mean")).filter("mean > 0.1")
    rows = counts.join(place, "sample").withColumn("pool", F.explode(F.sequence(F.col("at") - (size - 1), F.col("at"))))
    ratio = rows.groupBy(F.pmod("pool", F.lit(n)).alias("pool"), "feature").agg(F.sum("cnt").alias("s")).filter("s > 0").join(mean, "feature").select("pool", (F.col("s") / F.col("mean")).alias("r"))
    features = mean.count()
    low, high = (features + 1) // 2, features // 2 + 1  # the middle places, from 1
    absent = F.lit(features) - F.count(F.lit(1)).over(Window.partitionBy("pool"))
    placed = ratio.withColumn("at", absent + F.row_number().over(Window.partitionBy("pool").orderBy("r")))
    middle = placed.groupBy("pool").agg((F.coalesce(F.max(F.when(F.col("at") == low, F.col("r"))), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("at") == high, F.col("r"))), F.lit(0.0))).alias("twice"))
    pooled = np.zeros(n)
    for r in middle.collect():  # a row per sample
        pooled[r["pool"]] = r["twice"] / 2
    sf = np.maximum(_ring_solution(pooled, (ring["lib"] / ring["lib"].mean()).to_numpy(), size), 1e-6)
    return spark.createDataFrame(pd.DataFrame({"sample": ring["sample"], "sf": sf / sf.mean()}))


def normed(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """counts with sf scaled to a mean of one, and normed = cnt / sf."""
    scaled = factors.withColumn("sf", F.col("sf") / F.avg("sf").over(Window.partitionBy(F.lit(0))))
    return counts.join(F.broadcast(scaled), "sample").withColumn("normed", F.col("cnt") / F.col("sf"))


def dense(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Every sample of every feature (sample, feature, cnt, sf), zeros filled in; samples are the small side."""
    return counts.select("feature").distinct().join(F.broadcast(factors)).join(counts, ["sample", "feature"], "left").fillna(0, ["cnt"])


def _centred(df: DataFrame, r: Column, df_lost: int) -> DataFrame:
    own = Window.partitionBy("feature")
    df = df.withColumn("_r", r)
    df = df.withColumn("residual", F.col("_r") - F.avg("_r").over(own)).drop("_r")
    p = df.groupBy("feature").agg(F.sum(F.col("residual") ** 2).alias("chi2"), F.count(F.lit(1)).alias("n"))
    return df, p.withColumn("p", fc.chi2_p(F.col("chi2"), F.greatest(F.col("n") - df_lost, F.lit(1))))


def pearson_residuals(full: DataFrame, alpha: Column | float) -> tuple[DataFrame, DataFrame]:
    """full (sample, feature, cnt, sf) -> residuals, and chi-square p by feature; alpha: dispersion."""
    own = Window.partitionBy("feature")
    a = fc.clip(alpha if isinstance(alpha, Column) else F.lit(float(alpha)), F.lit(1e-5), F.lit(1e5))
    mu = F.avg(F.col("cnt") / F.col("sf")).over(own) * F.col("sf")
    df = full.withColumn("mu", mu).withColumn("_n", F.count(F.lit(1)).over(own))
    bound = F.sqrt(9 + F.col("_n") / 4)
    r = fc.clip((F.col("cnt") - F.col("mu")) / F.sqrt(F.col("mu") + a * F.col("mu") * F.col("mu")), -bound, bound)
    out, p = _centred(df, r, 1)
    return out.drop("mu", "_n"), p


def deviance_residuals(full: DataFrame, alpha: Column | float) -> tuple[DataFrame, DataFrame]:
    own = Window.partitionBy("feature")
    a = fc.clip(alpha if isinstance(alpha, Column) else F.lit(float(alpha)), F.lit(1e-5), F.lit(1e5))
    df = full.withColumn("mu", F.avg(F.col("cnt") / F.col("sf")).over(own) * F.col("sf"))
    x, mu = F.col("cnt"), F.col("mu")
    unit = F.when(x > 0, x * F.log(x / mu)).otherwise(0.0) - (x + 1 / a) * F.log((1 + a * x) / (1 + a * mu))
    r = F.signum(x - mu) * F.sqrt(F.greatest(2 * unit, F.lit(0.0)))
    out, p = _centred(df, r, 1)
    return out.drop("mu"), p


def dispersion(full: DataFrame, most: int = 5000, seed: int = 42) -> DataFrame:
    """Negative-binomial dispersion per feature by maximum likelihood on `most` features drawn by hash; -1: no fit."""
    some = full.select("feature").distinct().orderBy(F.xxhash64("feature", F.lit(seed)), "feature").limit(most)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, sf = pdf["cnt"].to_numpy(float), pdf["sf"].to_numpy(float)
        mu = max((x / sf).mean(), 1e-12) * sf
        lg = special.lgamma

        def nll(log_a: float) -> float:
            r = math.exp(-log_a)
            return -float(np.sum(lg(x + r) - math.lgamma(r) + r * np.log(r / (r + mu)) + x * np.log(mu / (r + mu))))

        lo, hi = math.log(1e-9), math.log(1e4)
        g = (math.sqrt(5) - 1) / 2
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        fc_, fd = nll(c), nll(d)
        for _ in range(80):  # golden section
            if fc_ < fd:
                hi, d, fd = d, c, fc_
                c = hi - g * (hi - lo)
                fc_ = nll(c)
            else:
                lo, c, fc_ = c, d, fd
                d = lo + g * (hi - lo)
                fd = nll(d)
        a = math.exp((lo + hi) / 2)
        return pd.DataFrame({"feature": pdf["feature"].iloc[:1].to_numpy(), "mean": [(x / sf).mean()], "alpha": [max(a, 1e-9) if math.isfinite(a) else -1.0]})

    kind = dict(full.dtypes)["feature"]
    return full.join(F.broadcast(some), "feature", "left_semi").groupBy("feature").applyInPandas(fit, f"feature {kind}, mean double, alpha double")


def mode(x: np.ndarray) -> float:
    """Place of the highest Gaussian density (Silverman's bandwidth) among the values."""
    sd = x.std(ddof=1) or 1e-9
    h = sd * (len(x) * 3 / 4) ** -0.2
    return float(x[np.exp(-(((x[:, None] - x[None]) / h) ** 2) / 2).sum(1).argmax()])


def trend(mean: np.ndarray, alpha: np.ndarray, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(quantiles, dispersions): modes by bins of the mean, made to fall with it, from the right."""
    edges = np.quantile(mean, np.linspace(0, 1, bins + 1))
    at = np.digitize(mean, edges)
    ok = alpha > 1e-3
    r = np.array([mode(alpha[(at == i) & ok]) if ((at == i) & ok).sum() > 5 else -1.0 for i in range(1, bins + 1)])
    return (np.arange(bins) + 0.5) / bins, np.maximum.accumulate(r[::-1])[::-1]


def fit_residuals(counts: DataFrame, factors: DataFrame, sub_sample: int = 5000, residuals: str = "pearson") -> tuple[DataFrame, DataFrame]:
    """(residuals, features): dispersion trend, residuals, and features that vary highly (BH of chi-square p < 5 %)."""
    sf = factors.withColumn("sf", F.col("sf") / F.avg("sf").over(Window.partitionBy(F.lit(0))))
    full = dense(counts, sf)
    fitted = dispersion(full, sub_sample).filter("alpha > 0").toPandas()
    means = full.groupBy("feature").agg(F.avg(F.col("cnt") / F.col("sf")).alias("mean"))
    n = means.count()
    ranked = fc.average_rank(means, "mean").withColumn("at", (F.col("rank") - 0.5) / n)
    if len(fitted) > 1:
        x, y = trend(fitted["mean"].to_numpy(), fitted["alpha"].to_numpy())
        usable = y > 0
        x, y = (x[usable], y[usable]) if usable.any() else (np.array([0.5]), np.array([1e-5]))
    else:
        x, y = np.array([0.5]), np.array([1e-5])

    def curve(at: pd.Series) -> pd.Series:
        return pd.Series(np.interp(at, x, y))

    alpha = ranked.select("feature", F.pandas_udf(curve, "double")("at").alias("alpha"))
    make = {"pearson": pearson_residuals, "deviance": deviance_residuals}[residuals]
    out, p = make(full.join(alpha, "feature"), F.col("alpha"))
    p = fc.bh(p.join(alpha, "feature"), "p")
    return out, p.withColumn("highly_variable", F.col("q") < 0.05)


def gram(residuals: DataFrame, value: str = "residual") -> tuple[list, np.ndarray]:
    """(samples, X X^T of the samples): summed in blocks of features, so the driver gets samples squared."""
    samples = [r[0] for r in residuals.select("sample").distinct().orderBy("sample").collect()]
    at = {s: i for i, s in enumerate(samples)}

    def block(frames):
        total = np.zeros((len(at), len(at)))
        for pdf in frames:
            m = pdf.pivot_table(index="feature", columns="sample", values=value, fill_value=0.0)
            i = [at[s] for s in m.columns]
            total[np.ix_(i, i)] += m.to_numpy().T @ m.to_numpy()
        yield pd.DataFrame({"i": np.repeat(np.arange(len(at)), len(at)), "j": np.tile(np.arange(len(at)), len(at)), "v": total.ravel()})

    vec = residuals.groupBy("feature").agg(F.collect_list(F.struct("sample", F.col(value).alias("v"))).alias("x"))

    def parts(frames):
        def long():
            for pdf in frames:
                e = pdf.explode("x")
                yield pd.DataFrame({"feature": e["feature"], "sample": [x["sample"] for x in e["x"]], value: [x["v"] for x in e["x"]]})

        yield from block(long())

    sums = vec.mapInPandas(parts, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((len(samples), len(samples)))
    out[sums["i"], sums["j"]] = sums["v"]
    return samples, out


def parallel_analysis(residuals: DataFrame, perm: int = 3, alpha: float = 0.01, min_comp: int = 0, whiten: bool = False, seed: int = 42) -> tuple[DataFrame, int]:
    """PCA scores of the samples up to the rank at which eigenvalues stop beating those of shuffled features."""
    order = Window.partitionBy("feature").orderBy("sample")
    own = Window.partitionBy("feature")
    base = residuals.withColumn("residual", F.col("residual") - F.avg("residual").over(own)).select("sample", "feature", "residual", F.row_number().over(order).alias("i"))
    samples, g = gram(base)
    values, vectors = np.linalg.eigh(g)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    null = []
    for k in range(perm):
        turn = Window.partitionBy("feature").orderBy(F.xxhash64("sample", "feature", F.lit(seed + k)), "sample")
        moved = base.select("feature", F.col("residual").alias("v"), F.row_number().over(turn).alias("i"))
        null.append(np.maximum(np.linalg.eigvalsh(gram(base.drop("residual").join(moved, ["feature", "i"]).withColumnRenamed("v", "residual"))[1])[::-1], 0))
    p = (np.array(null) >= values[None]).mean(0)
    for i in range(1, len(p)):
        p[i] = 1 - (1 - p[i - 1]) * (1 - p[i])
    rank = max(int((p <= alpha).sum()), min_comp)
    scores = vectors[:, :rank] * (1.0 if whiten else np.sqrt(values[:rank]))
    rows = [(s, [float(x) for x in r]) for s, r in zip(samples, scores, strict=True)]
    kind = dict(residuals.dtypes)["sample"]
    return residuals.sparkSession.createDataFrame(rows, f"sample {kind}, scores array<double>"), rank


# --- tests ------------------------------------------------------------------------------------------


def t_statistics(values: DataFrame, labels: DataFrame, value: str = "residual") -> DataFrame:
    """values (sample, feature, value), labels (sample, label): pooled t of each label against all other samples.

    From sums by (feature, label) alone: one pass, and nothing grows with the number of labels' samples.
    """
    own = Window.partitionBy("feature")
    g = values.join(F.broadcast(labels), "sample").groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    g = g.withColumns({"n0": F.sum("n").over(own) - F.col("n"), "s0": F.sum("s").over(own) - F.col("s"), "ss0": F.sum("ss").over(own) - F.col("ss")}).filter("n0 > 0")
    m1, m0 = F.col("s") / F.col("n"), F.col("s0") / F.col("n0")
    df = F.col("n") + F.col("n0") - 2
    pooled = (F.col("ss") - F.col("n") * m1 * m1 + F.col("ss0") - F.col("n0") * m0 * m0) / df
    t = F.when((df > 0) & (pooled > 1e-12), (m1 - m0) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("n0"))))
    return g.select("feature", "label", "n", "n0", m1.alias("mean_in"), m0.alias("mean_out"), df.alias("df"), t.alias("t"))


def differential(values: DataFrame, labels: DataFrame, counts: DataFrame, alternative: str = "greater", min_lfc: float = 0.25) -> DataFrame:
    """One label against the rest: t-test, log2 fold change of normed means, share expressed, gates, in order of merit."""
    t = t_statistics(values, labels)
    p = fc.t_p(F.coalesce(F.col("t"), F.lit(0.0)), F.greatest(F.col("df"), F.lit(1)))
    t = t.withColumn("p", F.when(F.col("t").isNull(), 1.0).otherwise(p if alternative == "greater" else 2 * fc.t_p(F.abs(F.coalesce(F.col("t"), F.lit(0.0))), F.greatest(F.col("df"), F.lit(1)))))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_in"))
    total = labels.count()
    own = Window.partitionBy("feature")
    e = counts.join(F.broadcast(labels), "sample").groupBy("feature", "label").agg(F.sum("normed").alias("s"), F.count_if(F.col("cnt") > 0).alias("pos"))
    e = e.withColumn("s0", F.sum("s").over(own) - F.col("s")).join(F.broadcast(sizes), "label")
    lfc = F.log2((F.col("s") / F.col("n_in") + 1e-3) / (F.col("s0") / (total - F.col("n_in")) + 1e-3))
    e = e.select("feature", "label", "n_in", lfc.alias("lfc"), (F.col("pos") / F.col("n_in")).alias("pct"))
    out = fc.bh(t.join(e, ["feature", "label"]), "p", by=["label"])
    up = (F.col("q") < 0.05) & (F.col("lfc") > min_lfc) & (F.col("pct") > F.greatest(F.lit(0.1), 1.5 / F.col("n_in")))
    down = (F.col("q") < 0.05) & (F.col("lfc") < -min_lfc)
    return out.withColumns({"upreg": up, "downreg": down}).orderBy("label", F.desc("upreg"), "p", F.desc("lfc"), "feature")


def regulated(tested: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of differential(): the features of each label that are up, and those that are down, each in its order of merit."""
    keep = columns or [c for c in tested.columns if c not in ("upreg", "downreg")]
    up = tested.filter("upreg").select(*keep).orderBy("label", "p", F.desc("lfc"), "feature")
    return up, tested.filter("downreg").select(*keep).orderBy("label", "p", "lfc", "feature")


def percent_mapped(counts: DataFrame, libraries: DataFrame) -> DataFrame:
    """counts, libraries (sample, reads) -> sample, percent: of the sample's reads, those in features. Samples without a count have 0; without reads, null."""
    own = counts.groupBy("sample").agg(F.sum("cnt").alias("_in"))
    return libraries.join(own, "sample", "left").select("sample", (F.coalesce("_in", F.lit(0)) * 100.0 / F.nullif(F.col("reads"), F.lit(0))).alias("percent"))


def label_log_ratio(profile: DataFrame, clusters: DataFrame) -> DataFrame:
    """profile (feature, label, x), clusters (feature, cluster) -> cluster, label, ln of the mean x over the mean of the other labels' means."""
    mean = profile.join(clusters, "feature").groupBy("cluster", "label").agg(F.avg("x").alias("m"))
    own = Window.partitionBy("cluster")
    others = (F.sum("m").over(own) - F.col("m")) / F.nullif(F.count("m").over(own) - 1, F.lit(0))
    return mean.withColumn("_o", others).select("cluster", "label", F.ln(F.col("m") / F.nullif(F.col("_o"), F.lit(0.0))).alias("log_ratio"))


def unique_markers(markers: DataFrame) -> DataFrame:
    """Markers (label, feature) of one label only."""
    once = markers.groupBy("feature").agg(F.count_distinct("label").alias("_n")).filter("_n = 1").select("feature")
    return markers.join(once, "feature", "left_semi")


def mann_whitney(values: DataFrame, value: str = "value", group: str = "in_group", by: list[str] | None = None, alternative: str = "two-sided") -> DataFrame:
    """U test with ties and continuity, asymptotic; group: boolean, true being group 0, whose values `greater` is about."""
    by = by or []
    ranked = fc.average_rank(values, value, by)
    ties = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_t")).groupBy(*by).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("tie"))
    s = ranked.groupBy(*by).agg(F.count_if(group).alias("n0"), F.count_if(~F.col(group)).alias("n1"), F.sum(F.when(F.col(group), F.col("rank"))).alias("r0"))
    out = s.join(ties, by) if by else s.join(ties)
    n = F.col("n0") + F.col("n1")
    u0 = F.col("r0") - F.col("n0") * (F.col("n0") + 1) / 2
    sd = F.sqrt(F.col("n0") * F.col("n1") / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    out = out.withColumns({"u0": u0, "u1": F.col("n0") * F.col("n1") - u0, "sd": sd}).filter("n0 > 0 and n1 > 0 and sd > 0")
    u = {"greater": F.col("u0"), "less": F.col("u1"), "two-sided": F.greatest("u0", "u1")}[alternative]
    out = out.withColumn("z", (u - F.col("n0") * F.col("n1") / 2 - 0.5) / F.col("sd"))
    p = fc.norm_p(F.col("z")) * (2 if alternative == "two-sided" else 1)
    return out.withColumn("p", fc.clip(p, F.lit(0.0), F.lit(1.0)))


def wilcoxon(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Signed ranks of a - b by key: n, w_plus, w_minus, number of positive pairs, median ratio."""
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).filter("_d <> 0").withColumn("_abs", F.abs("_d"))
    r = fc.average_rank(d, "_abs", by)
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.count_if(F.col("_d") > 0).alias("support"),
        F.median(F.col(a) / F.nullif(F.col(b), F.lit(0))).alias("median_fc"),
    )


def sparsity(counts: DataFrame, features: int, thresholds: tuple[int, ...] = (0, 1, 5)) -> DataFrame:
    """Share of all features at or below each threshold, by sample; absent counts are zero."""
    aggs = [((F.lit(features) - F.count_if(F.col("cnt") > t)) / features).alias(f"at_most_{t}") for t in thresholds]
    return counts.groupBy("sample").agg(*aggs, F.sum("cnt").alias("reads"))


def category_profile(values: DataFrame, labels: DataFrame, value: str = "cnt") -> DataFrame:
    """Mean per (feature, label), normalised by label, then by feature, then by label."""
    x = values.join(F.broadcast(labels), "sample").groupBy("feature", "label").agg(F.avg(value).alias("x"))
    for k in ("label", "feature", "label"):
        x = x.withColumn("x", F.col("x") / F.sum("x").over(Window.partitionBy(k)))
    return x


def biotype_ratio(values: DataFrame, value: str = "x") -> DataFrame:
    """values (feature, label, x, biotype): log2 of the ratio of mean x between every two biotypes, by label."""
    m = values.groupBy("label", "biotype").agg(F.avg(value).alias("m"))
    b = m.select("label", F.col("biotype").alias("other"), F.col("m").alias("m_other"))
    return m.join(b, "label").filter("biotype < other").select("label", "biotype", "other", F.log2(F.col("m") / F.col("m_other")).alias("log2_ratio"))


def pooled_profile(bins: DataFrame) -> DataFrame:
    """bins (region, bin, sample, cnt): sum over samples of count / mean over the sum of means, scaled to each region's maximum."""
    mean = bins.groupBy("sample").agg(F.avg("cnt").alias("mean"))
    total = mean.agg(F.sum("mean").alias("total"))
    x = bins.join(F.broadcast(mean), "sample").groupBy("region", "bin").agg(F.sum(F.col("cnt") / F.col("mean")).alias("x")).join(F.broadcast(total))
    x = x.withColumn("x", F.col("x") / F.col("total")).drop("total")
    return x.withColumn("scaled", F.col("x") / F.max("x").over(Window.partitionBy("region")))


def stratified_folds(labels: DataFrame, folds: int = 10, seed: int = 42) -> DataFrame:
    """sample, label, fold: even shares of each label by hash order."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("sample", F.lit(seed)), "sample")
    return labels.withColumn("fold", (F.row_number().over(order) - 1) % folds)


def cross_validated(scores: DataFrame, labels: DataFrame, folds: int = 5, model: str = "logistic") -> DataFrame:
    """scores (sample, scores array), labels (sample, label): predictions of each fold by a model fitted on the others."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    names = [r[0] for r in labels.select("label").distinct().orderBy("label").collect()]
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")).cast("double") - 1
    rows = stratified_folds(labels, folds).join(scores, "sample").withColumns({"y": code, "x": array_to_vector("scores")}).cache()
    make = {"logistic": lambda: LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01), "forest": lambda: RandomForestClassifier(featuresCol="x", labelCol="y", seed=42)}[model]
    out = None
    for k in range(folds):
        part = make().fit(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k)).select("sample", "y", "prediction", "fold")
        out = part if out is None else out.unionByName(part)
    return out


def confusion_metrics(predicted: DataFrame) -> DataFrame:
    """predicted (y, prediction): recall and precision by class, and balanced accuracy."""
    c = predicted.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumns({"actual": F.sum("n").over(Window.partitionBy("y")), "called": F.sum("n").over(Window.partitionBy("prediction"))})
    each = predicted.select("y").distinct().join(c.filter("y = prediction"), "y", "left")
    each = each.select("y", F.coalesce(F.col("n") / F.col("actual"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("n") / F.col("called"), F.lit(0.0)).alias("precision"))
    return each.withColumn("balanced_accuracy", F.avg("recall").over(Window.partitionBy(F.lit(0))))


def resampled_detection(values: DataFrame, labels: DataFrame, truth: DataFrame, sizes: tuple[int, ...], reps: int = 5, seed: int = 42) -> DataFrame:
    """Precision and recall against truth (feature) of one-sided t-tests on `sizes` samples per label, reps times each.

    Repetitions are a key, not a loop; subsets are drawn by hash order.
    """
    spark = values.sparkSession
    grid = spark.createDataFrame([(s, r) for s in sizes for r in range(reps)], "size int, rep int")
    order = Window.partitionBy("size", "rep", "label").orderBy(F.xxhash64("sample", "rep", "size", F.lit(seed)), "sample")
    chosen = labels.join(F.broadcast(grid)).withColumn("_r", F.row_number().over(order)).filter("_r <= size").drop("_r")
    own = Window.partitionBy("size", "rep", "feature")
    g = values.join(F.broadcast(chosen), "sample").groupBy("size", "rep", "feature", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("m"), F.coalesce(F.var_samp("residual"), F.lit(0.0)).alias("v"))
    g = g.withColumns({"m0": F.sum("m").over(own) - F.col("m"), "v0": F.sum("v").over(own) - F.col("v"), "n0": F.sum("n").over(own) - F.col("n")}).filter("n0 > 1 and n > 1 and v + v0 > 0")
    df = F.col("n") + F.col("n0") - 2
    t = (F.col("m") - F.col("m0")) / F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("n0") - 1) * F.col("v0")) / df * (1 / F.col("n") + 1 / F.col("n0")))
    p = fc.bh(g.withColumn("t", t).withColumn("p", fc.t_p(F.col("t"), df)), "p", by=["size", "rep", "label"])
    hit = p.filter("q < 0.05").join(truth.withColumn("true", F.lit(1)), "feature", "left")
    n_true = truth.count()
    return hit.groupBy("size", "rep", "label").agg((F.count("true") / F.count(F.lit(1))).alias("precision"), (F.count("true") / max(n_true, 1)).alias("recall"))


def log_z(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """z-score of log(1 + value) by key, population deviation."""
    x = F.log1p(value)
    w = Window.partitionBy(*by)
    return df.withColumn("z", (x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)))


def impute_standardise(df: DataFrame, value: str) -> DataFrame:
    med = df.agg(F.median(value).alias("_m"))
    x = df.join(F.broadcast(med)).withColumn(value, F.coalesce(F.col(value), F.col("_m"))).drop("_m")
    s = x.agg(F.avg(value).alias("_a"), F.stddev_pop(value).alias("_s"))
    return x.join(F.broadcast(s)).withColumn(value, (F.col(value) - F.col("_a")) / F.col("_s")).drop("_a", "_s")
