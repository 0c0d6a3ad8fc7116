"""Consensus regions from many peak sets: a smoothed pile-up of summits, split at its local minima.

The density of summits further apart than the kernel's window doesn't mix, so summits fall into islands that are
worked on as independent groups, whatever the length of a chromosome.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import with_runs


def pile_up(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("strand", "chrom", "summit").agg(F.count(F.lit(1)).alias("n"))


def sigma(peaks: DataFrame, chrom_sizes: DataFrame, rule: str | float = "auto_1") -> float:
    """auto_1: an eighth of the mean peak size; auto_2: ln 10 * (genome * strands / n) / sqrt 2."""
    if not isinstance(rule, str):
        return float(rule)
    row = peaks.agg(F.avg(F.col("end") - F.col("start")).alias("size"), F.count(F.lit(1)).alias("n"), F.count_distinct("strand").alias("strands")).first()
    if rule == "auto_1":
        return row["size"] / 8
    if rule == "auto_2":
        genome = chrom_sizes.agg(F.sum("length")).first()[0]
        return math.log(10) * (genome / row["n"] * row["strands"]) / math.sqrt(2)
    raise ValueError(f"unknown rule {rule!r}")


def check_strands(peaks: DataFrame, unstranded: bool = False) -> DataFrame:
    peaks = peaks.withColumn("strand", F.lit(".") if unstranded else F.coalesce("strand", F.lit(".")))
    seen = [r[0] for r in peaks.select("strand").distinct().limit(4).collect()]
    if len(seen) > 2 or (len(seen) > 1 and "." in seen):
        raise ValueError(f"strands can't be mixed: {sorted(seen)}")
    return peaks


def separators(summit: np.ndarray, weight: np.ndarray, width: float, size: int) -> tuple[int, np.ndarray]:
    """(offset, places) of the cuts in one island: first places of runs of local minima of the density.

    size: of the kernel. Beyond size // 2 of every summit the density is zero, and the first zero place behind the
    island is a cut as well.
    """
    lo, hi = int(summit[0]) - size, int(summit[-1]) + size
    pile = np.zeros(hi - lo + 1)
    np.add.at(pile, summit - lo, weight)
    j = np.arange(size)
    kernel = np.exp(-((j - (size - 1) / 2) ** 2) / (2 * width * width))
    density = np.convolve(pile, kernel)[(size - 1) // 2 : (size - 1) // 2 + len(pile)]
    padded = np.concatenate([[density[0]], density, [density[-1]]])
    low = (density <= padded[:-2]) & (density <= padded[2:])
    heads = np.flatnonzero(low & ~np.concatenate([[False], low[:-1]]))
    return lo, heads[heads > 0]  # the first run is the space before the island


def bounds(summit: np.ndarray, island: np.ndarray, length: np.ndarray, width: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cuts around each summit, as separators() has them, of many islands (0, 1, ...; sorted, then by summit) at once.

    Islands are laid one behind the other, each with the kernel's size of room at both ends: no density reaches the next.
    """
    first = np.flatnonzero(np.diff(island, prepend=-1))
    lo = summit[first] - size
    room = summit[np.append(first[1:], len(summit)) - 1] + size - lo + 1
    base = np.cumsum(room) - room
    place = summit - lo[island] + base[island]
    _, heads = separators(place, np.ones(len(place)), width, size)
    of = np.searchsorted(base, heads, side="right") - 1
    cuts, far = heads - base[of] + lo[of], length[first]
    cuts = np.clip(cuts, 0, far[of])
    at = np.searchsorted(heads, place, side="right")
    none = np.full(1, -1)
    before, after = np.concatenate([none, of])[at], np.concatenate([of, none])[at]
    left = np.where(before == island, np.concatenate([none, cuts])[at], 0)
    return left, np.where(after == island, np.concatenate([cuts, none])[at], far[island])


def _runs(summit: np.ndarray, first: np.ndarray, size: int, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring islands, which begin at `first`, as many as first reach `most` places."""
    stop = np.append(first[1:], len(summit))
    ends, at = np.cumsum(summit[stop - 1] - summit[first] + 2 * size + 1), 0
    while at < len(first):
        to = min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1, len(first))
        yield int(first[at]), int(stop[to - 1])
        at = to


class ConsensusBuilder:
    """chrom_sizes: chrom, length. Chromosomes that are absent from it are left out; absent() reports them."""

    def __init__(self, chrom_sizes: DataFrame, score: str = "binary"):
        self.chrom_sizes, self.score = chrom_sizes, score

    def absent(self, peaks: DataFrame) -> DataFrame:
        return peaks.join(F.broadcast(self.chrom_sizes), "chrom", "left_anti").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))

    def segments(self, peaks: DataFrame, sigma_: str | float = "auto_1", per_peak: float | None = None, unstranded: bool = False) -> DataFrame:
        """peaks with the cuts around them (sep_l, sep_r); per_peak: each peak's sigma as a multiple of its length."""
        peaks = check_strands(peaks, unstranded).join(F.broadcast(self.chrom_sizes), "chrom")
        width = sigma(peaks, self.chrom_sizes, sigma_)
        if per_peak is not None:
            width = float(peaks.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1) * per_peak
        width = max(width, 1e-3)
        size = int(8 * width) + 1
        islands = with_runs(peaks.withColumn("_to", F.col("summit")), ["strand", "chrom"], "summit", "_to", gap=size, name="island").drop("_to")

        def cuts_of(s: np.ndarray, reach: np.ndarray) -> np.ndarray:
            lo, hi = int(s[0]) - size, int(s[-1]) + size
            x, density = np.arange(lo, hi + 1), np.zeros(hi - lo + 1)
            for c, w in zip(s, reach, strict=True):
                density += np.exp(-((x - c) ** 2) / (2 * max(w, 1e-3) ** 2))
            density[density < 1e-12] = 0
            padded = np.concatenate([[density[0]], density, [density[-1]]])
            low = (density <= padded[:-2]) & (density <= padded[2:])
            heads = np.flatnonzero(low & ~np.concatenate([[False], low[:-1]]))
            return heads[heads > 0] + lo

        columns, keys = islands.columns, ("strand", "chrom")

        def cut(t: pa.Table) -> pa.Table:
            t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (*keys, "island", "summit", "start", "end")]))
            summit, island, start, end, length = (t[c].to_numpy().astype(np.int64) for c in ("summit", "island", "start", "end", "length"))
            other = island[1:] != island[:-1]
            for k in keys:
                codes = t[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                other |= codes[1:] != codes[:-1]
            first = np.flatnonzero(np.concatenate([[True], other]))
            left, right = np.zeros(len(summit), np.int64), np.zeros(len(summit), np.int64)
            if per_peak is None:
                at = np.zeros(len(summit), np.int64)
                at[first[1:]] = 1
                for i, j in _runs(summit, first, size, 1 << 22):
                    left[i:j], right[i:j] = bounds(summit[i:j], np.cumsum(at[i:j]) - at[i], length[i:j], width, size)
            else:
                reach = (end - start) * per_peak
                for i, j in zip(first, np.append(first[1:], len(summit)), strict=True):
                    cuts = cuts_of(summit[i:j], reach[i:j])
                    edges = np.concatenate([[0], np.clip(cuts, 0, length[i]), [length[i]]])
                    at = np.searchsorted(cuts, summit[i:j], side="right")
                    left[i:j], right[i:j] = edges[at], edges[at + 1]
            return t.select(columns).append_column("sep_l", pa.array(left)).append_column("sep_r", pa.array(right))

        schema = islands.schema.simpleString()[7:-1].replace(":", " ") + ",sep_l bigint,sep_r bigint"
        lots = islands.withColumn("_lot", F.floor(F.col("island") / 16384))  # islands are small; a task call takes many
        return lots.groupBy("strand", "chrom", "_lot").applyInArrow(cut, schema)

    def build(self, peaks: DataFrame, sigma_: str | float = "auto_1", min_overlap: int = 2, per_peak: float | None = None, unstranded: bool = False) -> tuple[DataFrame, DataFrame]:
        """(consensus, presence): regions with at least min_overlap peaks, and which experiment has which."""
        parts = self.segments(peaks, sigma_, per_peak, unstranded)
        key = ["strand", "chrom", "island", "sep_l"]
        regions = parts.groupBy(*key).agg(
            F.greatest(F.min("start"), F.first("sep_l")).alias("start"),
            F.least(F.max("end"), F.first("sep_r")).alias("end"),
            F.floor(F.avg("summit")).alias("center"),
            F.count(F.lit(1)).alias("n_peaks"),
        )
        regions = dense_ids(regions.filter(F.col("n_peaks") >= min_overlap), ["strand", "chrom"], ["center", "island", "sep_l"])
        rows = parts.join(regions.select("id", *key), key)
        if self.score == "binary":
            presence = rows.select("id", "experiment").distinct().withColumn("value", F.lit(1.0))
        else:
            presence = rows.groupBy("id", "experiment").agg(F.max_by("score", F.struct("summit", "start", "end", "score")).alias("value"))
        return regions.select("chrom", "start", "end", "id", "n_peaks", "strand", "center", (F.col("center") + 1).alias("center_end")), presence


def dense_ids(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Ids from 0 in the order of keys, then order: numbered per key, shifted by the sizes of the keys before."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(*keys)) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_i", local).join(F.broadcast(sizes), keys).withColumn("id", (F.col("_before") + F.col("_i")).cast("long")).drop("_i", "_before")


def usable_experiments(peaks: DataFrame, more_than: int = 100) -> DataFrame:
    """Peaks of experiments with more peaks than that."""
    enough = peaks.groupBy("experiment").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than).select("experiment")
    return peaks.join(enough, "experiment", "left_semi")


def multiplicities(consensus: DataFrame, percent: float = 0.95) -> DataFrame:
    """How many regions have how many peaks, the tail beyond the percentile put together."""
    cap = consensus.agg(F.percentile("n_peaks", F.lit(percent)).alias("cap"))
    return consensus.join(F.broadcast(cap)).groupBy(F.least("n_peaks", F.col("cap").cast("long")).alias("n_peaks")).agg(F.count(F.lit(1)).alias("regions"))
