"""Running sums and minima over all rows in the order of a number, without one task that sees all of them.

Rows are dealt to value ranges: magnitudes by the binary logarithm, 256 ranges to a power of two, so that no pass over
the data has to find bounds. Each range is scanned by itself, and the ranges' totals, of which a key has some thousands
whatever the number of its rows, are scanned as one list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges to a power of two, as a power of two.
SPLIT = 8
#: Above the logarithm of every double.
FAR = 1100


def value_range(value: Column) -> Column:
    """A long that never falls while value grows; nulls and NaN give null. -0.0 and 0.0 share a range."""
    size = F.floor(F.log2(F.abs(value)) * (1 << SPLIT)).cast("long") + (FAR << SPLIT)
    far = F.lit(2 * FAR << SPLIT).cast("long")
    size = F.when(F.abs(value) == float("inf"), far).otherwise(size)
    return F.when(F.isnan(value) | value.isNull(), None).when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys, in which nulls are equal; b's keys are dropped."""
    names = {k: f"_on_{k}" for k in keys}
    b = b.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, other in names.items():
        cond &= F.col(k).eqNullSafe(F.col(other))
    return a.join(b, cond, how).drop(*names.values())


def _before(name: str, falling: bool) -> Callable[[Column], Column]:
    """An array's running total of the elements before each one (behind it, if falling): 0 or nan for the first."""

    def run(lists: pd.Series) -> pd.Series:
        out = []
        for x in lists:
            x = np.asarray(x, np.int64 if name == "sum" else float)[:: -1 if falling else 1]
            if name == "sum":
                y = np.cumsum(x) - x
            else:
                y = np.append(np.nan, (np.fmin if name == "min" else np.fmax).accumulate(x)[:-1]) if len(x) else x
            out.append(y[:: -1 if falling else 1])
        return pd.Series(out)

    return F.pandas_udf(run, "array<long>" if name == "sum" else "array<double>")


def _scan(df: DataFrame, by: list[str], value: str, weight: str, out: str, name: str, falling: bool) -> DataFrame:
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[name]
    rows = df.withColumn("_range", value_range(F.col(value).cast("double")))
    order = (F.desc if falling else F.asc)(value)
    own = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    lists = rows.groupBy(*by, "_range").agg(agg(weight).alias("_t")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_range", "_t"))).alias("_all"))
    lists = lists.select(*by, F.col("_all._range").alias("_range"), _before(name, falling)(F.col("_all._t")).alias("_before"))
    lists = lists.select(*by, F.explode(F.arrays_zip("_range", "_before")).alias("_x")).select(*by, "_x._range", "_x._before")
    rows = join_on(rows.withColumn("_own", agg(weight).over(own)), lists, [*by, "_range"])
    before = F.col("_before")
    whole = F.col("_own") + before if name == "sum" else (F.least if name == "min" else F.greatest)("_own", F.when(~F.isnan(before), before))
    return rows.withColumn(out, whole).drop("_own", "_before", "_range")


def running_sum(df: DataFrame, value: str, weight: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df (a row per key `by` and value, neither null nor NaN; weight: an integer) with the sum of weight over values up to its own."""
    return _scan(df, by or [], value, weight, out, "sum", falling=False)


def minimum_from(df: DataFrame, value: str, weight: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df (a row per key `by` and value) with the least weight among values from its own upwards."""
    return _scan(df, by or [], value, weight, out, "min", falling=True)


def maximum_to(df: DataFrame, value: str, weight: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df (a row per key `by` and value) with the largest weight among values up to its own."""
    return _scan(df, by or [], value, weight, out, "max", falling=False)


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name in shares, the exact percentile of value, interpolated as F.percentile does; null without values.

    A key's values lie in many ranges, so no task holds them, be the keys ever so few; a row per key is broadcast. Nulls
    don't count; values must not be NaN.
    """
    sizes = df.groupBy(*by).agg((F.count(value) - 1).alias("_top"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    rows = join_on(running_sum(counts, "_value", "_n", "_last", by), F.broadcast(sizes), by)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_last") > place) & (F.col("_last") - F.col("_n") <= place), F.col("_value")).cast("double"))

    near = []
    for name, share in shares.items():
        place = F.col("_top") * share
        near += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    out = join_on(sizes, rows.groupBy(*by).agg(*near), by, "left")
    part = {name: F.col("_top") * share - F.floor(F.col("_top") * share) for name, share in shares.items()}
    return out.select(*by, *[((1 - x) * F.col(f"_lo_{n}") + x * F.col(f"_hi_{n}")).alias(n) for n, x in part.items()])
