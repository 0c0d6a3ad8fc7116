"""Column expressions and Arrow UDFs that several operators use."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered, special


def _udf(fn):
    fn = np.vectorize(fn, otypes=[float])

    def run(*args: pd.Series) -> pd.Series:
        return pd.Series(fn(*[a.to_numpy() for a in args]) if len(args[0]) else np.zeros(0))

    return run


def _of_distinct(fn, *args: pd.Series) -> pd.Series:
    """fn of arrays, called with the distinct rows of a batch only; nan where an argument is null."""
    x = np.column_stack([a.to_numpy(float, na_value=np.nan) for a in args])
    known = ~np.isnan(x).any(axis=1)
    out = np.full(len(x), np.nan)
    if known.any():
        rows, which = np.unique(x[known], axis=0, return_inverse=True)
        out[known] = fn(*rows.T)[which.ravel()]
    return pd.Series(out)


def hypergeom_p(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k); 1 where undefined."""

    def run(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
        return _of_distinct(lambda *x: special.hypergeom_tails(*x)[0], k, total, marked, drawn).fillna(1.0)

    return F.pandas_udf(run, "double")(k, total, marked, drawn)


def hypergeom_two_sided_p(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """Twice the smaller of P(X >= k) and P(X <= k-1), which isn't capped; 1 where undefined."""

    def run(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
        return _of_distinct(lambda *x: 2 * np.minimum(*special.hypergeom_tails(*x)), k, total, marked, drawn).fillna(1.0)

    return F.pandas_udf(run, "double")(k, total, marked, drawn)


def binom_two_sided_p(k: Column, n: Column, p: Column) -> Column:
    def run(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return _udf(special.binom_two_sided)(k, n, p)

    return F.pandas_udf(run, "double")(k, n, p)


def t_p(t: Column, df: Column) -> Column:
    """One-sided upper tail."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return _udf(special.t_sf)(t, df)

    return F.pandas_udf(run, "double")(t, df)


def chi2_p(x: Column, df: Column) -> Column:
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return _udf(special.chi2_sf)(x, df)

    return F.pandas_udf(run, "double")(x, df)


def norm_p(z: Column) -> Column:
    def run(z: pd.Series) -> pd.Series:
        return _udf(special.norm_sf)(z)

    return F.pandas_udf(run, "double")(z)


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed up to 64 terms, by its asymptotic series beyond (whose error is below 1e-15 there)."""
    x = m.cast("double")
    series = F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    return F.when(m <= 64, few).otherwise(series)


#: Corrections by name: p and its rank from 1 (that of the last of its ties, then that of the first) among m -> raw value, and which way it is made monotone.
CORRECTIONS: dict[str, tuple[Callable[[Column, Column, Column, Column], Column], str | None]] = {
    "bh": (lambda p, last, first, m: p * m / last, "up"),
    "by": (lambda p, last, first, m: p * m / last * _harmonic(m), "up"),
    "holm": (lambda p, last, first, m: p * (m - first + 1), "down"),
    "hochberg": (lambda p, last, first, m: p * (m - last + 1), "up"),
    "bonferroni": (lambda p, last, first, m: p * m, None),
}


Correction = str | Callable[[Column, Column, Column, Column], Column]


def adjust(df: DataFrame, p: str, q: str | dict[str, Correction] = "q", by: list[str] | None = None, method: Correction = "bh", tests: int | None = None) -> DataFrame:
    """df with p-values corrected for their number, by key; at most 1. q: the new column, or several and the method of each.

    tests: how many there are for each key, if those of p = 1 are not all listed.
    method: a name in CORRECTIONS, or a function of (p, rank of the last of its ties, of the first, m) whose values are then
    stepped up (the least among equal or larger p). Null and NaN p-values aren't counted and get null.
    Only distinct p-values are ordered, in ranges of their values, so neither ties nor their number meet in one task.
    """
    by, wanted = by or [], q if isinstance(q, dict) else {q: method}
    unknown = [m for m in wanted.values() if isinstance(m, str) and m not in CORRECTIONS]
    if unknown:
        raise ValueError(f"method has to be one of {', '.join(CORRECTIONS)}, or a function")
    counts = df.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    m = counts.groupBy(*by).agg(F.greatest(F.sum("_n"), F.lit(tests or 0)).alias("_m"))
    counts = ordered.join_on(counts, m, by) if by else counts.join(F.broadcast(m))  # one row
    counts = ordered.running_sum(counts, p, "_n", "_last", by)
    for name, how in wanted.items():
        raw, way = CORRECTIONS[how] if isinstance(how, str) else (how, "up")
        counts = counts.withColumn(name, raw(F.col(p), F.col("_last"), F.col("_last") - F.col("_n") + 1, F.col("_m")).cast("double"))
        if way is not None:
            counts = (ordered.minimum_from if way == "up" else ordered.maximum_to)(counts.withColumnRenamed(name, "_r"), p, "_r", name, by).drop("_r")
    counts = counts.select(*by, p, *[F.least(F.lit(1.0), F.col(c)).alias(c) for c in wanted])
    columns = [c for c in df.columns if c not in wanted]
    return ordered.join_on(df.select(*columns), counts, [*by, p], "left").select(*columns, *wanted)


def bh(df: DataFrame, p: str, q: str = "q", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: the least p * m / rank among equal or larger p, at most 1."""
    return adjust(df, p, q, by, "bh")


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Average ranks from 1, by key, and `ties`; ranks are summed over distinct values, in ranges of them. Rows without a value or key are left out."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties")).filter(F.col(value).isNotNull())
    counts = ordered.running_sum(counts, value, "ties", name, by).withColumn(name, F.col(name) - (F.col("ties") - 1) / 2)
    return df.join(counts, [*by, value])


def round6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def cap_text(c: Column, n: int) -> Column:
    return F.when(F.length(c) < n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...")))


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def motif_name(c: Column) -> Column:
    """The name of a motif before its first slash and bracket."""
    return F.regexp_extract(c, r"^([^/(]*)", 1)


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, n): values in [edge_i, edge_i+1), the last bin closed; values outside and nulls are left out."""
    x = F.col(column)
    at = sum((F.when(x >= e, 1).otherwise(0) for e in edges[:-1]), F.lit(0)) - 1
    inside = df.filter((x >= edges[0]) & (x <= edges[-1]))
    return inside.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density_grid(df: DataFrame, x: str, y: str, pixels: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """(px, py, n) of points in a grid of pixels over (low x, high x, low y, high y)."""
    x0, x1, y0, y1 = bounds

    def cell(c: str, low: float, high: float) -> Column:
        return F.least(F.floor((F.col(c) - low) / (high - low) * pixels), F.lit(pixels - 1)).cast("int")

    rows = df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return rows.groupBy(cell(x, x0, x1).alias("px"), cell(y, y0, y1).alias("py")).agg(F.count(F.lit(1)).alias("n"))


def palette(n: int) -> list[tuple[float, float, float]]:
    """n distinct colours: hues along the golden ratio at full enough saturation."""
    import colorsys

    return [colorsys.hsv_to_rgb(i * 0.6180339887498949 % 1, 0.65 + 0.3 * (i % 2), 0.95 - 0.25 * (i // 2 % 2)) for i in range(n)]
