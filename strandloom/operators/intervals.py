"""Interval joins and interval algebra on half-open intervals (chrom, start, end).

Overlap joins are equi-joins on (chrom, bin): both sides are exploded over the fixed-width bins they touch, and a pair
is kept only in the bin where the later of the two starts lies, so that no distinct is needed. Scans over sorted
intervals work in two levels, inside genome tiles and then over one row per tile, so that no task holds a chromosome.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session

TILE = 1 << 20


def _bins(start: Column, end: Column, width: int) -> Column:
    lo = F.floor(start / width)
    return F.sequence(lo, F.greatest(lo, F.floor((end - 1) / width)))


def _suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([F.col(c).alias(c + suffix) for c in df.columns])


def _binned(a: DataFrame, b: DataFrame, width: int, strand: bool, within: bool) -> DataFrame:
    a = a.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), width)))
    b = b.withColumn("_bin_b", F.explode(_bins(F.col("start_b"), F.col("end_b"), width)))
    on = (F.col("chrom") == F.col("chrom_b")) & (F.col("_bin") == F.col("_bin_b"))
    on &= (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end"))
    on &= F.col("_bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("start_b") / width))
    if strand:
        on &= F.col("strand") == F.col("strand_b")
    if within:
        on &= (F.col("start_b") <= F.col("start")) & (F.col("end") <= F.col("end_b"))
    return a.join(b, on).drop("_bin", "_bin_b")


def overlap_join(a: DataFrame, b: DataFrame, slack: int = 0, strand: bool = False, within: bool = False, width: int = 1 << 14, long_from: int | None = None) -> DataFrame:
    """Every overlapping pair; b's columns get the suffix _b. Empty intervals overlap nothing.

    slack widens b by that many bases at both ends; strand asks for equal strands; within asks for a inside b.
    width should be near the usual length. long_from: intervals from this length on are joined apart, over bins as wide,
    so that a few long ones don't explode into many bins.
    """
    b = _suffixed(b, "_b").filter("end_b > start_b")
    a = a.filter("end > start")
    if slack:
        b = b.withColumns({"start_b": F.col("start_b") - slack, "end_b": F.col("end_b") + slack})
    if long_from is None:
        out = _binned(a, b, width, strand, within)
    else:
        la, lb = F.col("end") - F.col("start") >= long_from, F.col("end_b") - F.col("start_b") >= long_from
        out = _binned(a.filter(~la), b.filter(~lb), width, strand, within)
        out = out.unionByName(_binned(a.filter(la), b, long_from, strand, within))
        out = out.unionByName(_binned(a.filter(~la), b.filter(lb), long_from, strand, within))
    return out.withColumns({"start_b": F.col("start_b") + slack, "end_b": F.col("end_b") - slack}) if slack else out


def overlap_counts(a: DataFrame, b: DataFrame, name: str, tile: int = 1 << 17) -> DataFrame:
    """(name, n): how many rows of a overlap b's rows of that name, without the pairs themselves; names without any are left out.

    Both are dealt to the tiles they touch. In a tile, b overlaps what starts before its end less what ends up to its start;
    pairs of which both lie in the tile before too were counted there.
    """
    session.ship(a.sparkSession)
    kind = dict(b.dtypes)[name]

    def dealt(df: DataFrame, *more: str) -> DataFrame:
        long = [F.col(c).cast("long").alias(c) for c in ("start", "end")]
        return df.filter("chrom is not null and end > start").select("chrom", *long, *more).withColumn("_tile", F.explode(_bins(F.col("start"), F.col("end"), tile)))

    def count(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column(name)
        if not left.num_rows or not right.num_rows:
            return pa.table({name: names.slice(0, 0), "n": pa.array([], pa.int64())})
        lo = key[1].as_py() * tile
        (s, e), (t, u) = ([x.column(c).to_numpy() for c in ("start", "end")] for x in (left, right))
        n = np.searchsorted(np.sort(s), u, "left") - np.searchsorted(np.sort(e), t, "right")
        # what ends before the tile isn't here, so a row of b that starts before it would count all that does, too
        n = n - np.where(t < lo, np.count_nonzero(s < lo), 0)
        some = n > 0
        return pa.table({name: names.filter(pa.array(some)), "n": n[some]})

    key = ("chrom", "_tile")
    parts = dealt(a).groupBy(*key).cogroup(dealt(b, name).groupBy(*key)).applyInArrow(count, f"{name} {kind}, n long")
    return parts.groupBy(name).agg(F.sum("n").alias("n"))


def _having(a: DataFrame, b: DataFrame, how: str, **options) -> DataFrame:
    hits = _suffixed(overlap_join(a, b.select("chrom", "start", "end", *(["strand"] if options.get("strand") else [])), **options).select(a.columns).distinct(), "_h")
    on = None
    for c in a.columns:
        same = F.col(c).eqNullSafe(F.col(c + "_h"))
        on = same if on is None else on & same
    return a.join(hits, on, how)


def overlapping(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """Rows of a that overlap any row of b, each once."""
    return _having(a, b, "left_semi", **options)


def not_overlapping(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """Rows of a that overlap no row of b; also subtracts every touched interval whole."""
    return _having(a, b, "left_anti", **options)


def intersect(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """a clipped to each overlap with b."""
    cols = a.columns
    out = overlap_join(a, b.select("chrom", "start", "end"), **options)
    return out.withColumns({"start": F.greatest("start", "start_b"), "end": F.least("end", "end_b")}).select(cols)


# --- scans in order -------------------------------------------------------------------------------


def with_runs(df: DataFrame, keys: list[str], at: str, until: str, gap: int = 0, tile: int = TILE, name: str = "run") -> DataFrame:
    """Numbers runs, per key in order of `at`: a row starts a run if it lies more than gap behind all `until` before it."""
    df = df.withColumn("_tile", F.floor(F.col(at) / tile))
    tiles = df.groupBy(*keys, "_tile").agg(F.max(until).alias("_max"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.withColumn("_prior", F.max("_max").over(before)).drop("_max")
    df = df.join(tiles, [*keys, "_tile"])
    local = Window.partitionBy(*keys, "_tile").orderBy(at, until)
    prior = F.greatest(F.col("_prior"), F.max(until).over(local.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_new", F.when(prior.isNull() | (F.col(at) > prior + gap), 1).otherwise(0))
    counts = df.groupBy(*keys, "_tile").agg(F.sum("_new").alias("_n"))
    counts = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    df = df.withColumn("_local", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.join(counts, [*keys, "_tile"])
    return out.withColumn(name, F.col("_offset") + F.col("_local")).drop("_tile", "_prior", "_new", "_local", "_offset")


def merge(df: DataFrame, gap: int = 0) -> DataFrame:
    """Unions of overlapping or book-ended intervals (or such that at most gap bases part)."""
    runs = with_runs(df.select("chrom", "start", "end").filter("end > start").distinct(), ["chrom"], "start", "end", gap)
    return runs.groupBy("chrom", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def complement(df: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """What df leaves free of the chromosomes in chrom_sizes (chrom, length)."""
    inside = df.join(chrom_sizes, "chrom").select("chrom", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "length").alias("end"))
    # Each chromosome's ends take part as empty intervals; merged intervals are disjoint, so neighbours bound the gaps.
    ends = chrom_sizes.select("chrom", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("s")), F.struct(F.col("length").cast("long").alias("s")))).alias("x")).select("chrom", F.col("x.s").alias("start"), F.col("x.s").alias("end"))
    pieces = merge(inside).unionByName(ends)
    order = Window.partitionBy("chrom").orderBy("start", "end")
    gaps = pieces.select("chrom", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("start"), F.lead("start").over(order).alias("end"))
    return gaps.filter("end > start")


# --- windows ---------------------------------------------------------------------------------------


def extend(df: DataFrame, by: int) -> DataFrame:
    return df.withColumns({"start": F.greatest(F.col("start") - by, F.lit(0)), "end": F.col("end") + by})


def shrink_stranded(df: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """Takes upstream bases off the 5' end and downstream off the 3' end; empty remains go."""
    plus = F.col("strand") == "+"
    s = F.when(plus, F.col("start") + upstream).otherwise(F.col("start") + downstream)
    e = F.when(plus, F.col("end") - downstream).otherwise(F.col("end") - upstream)
    return df.withColumns({"start": s, "end": e}).filter("start < end")


def tss(df: DataFrame) -> Column:
    return F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end") + 1)


def promoters(genes: DataFrame, reach: int = 1000) -> DataFrame:
    at = tss(genes)
    return genes.withColumns({"start": F.greatest(at - reach, F.lit(0)), "end": at + reach})


def tails(genes: DataFrame, lengths: tuple[int, ...] = (5000, 7000, 9000), inside: bool = False) -> DataFrame:
    """A window per length behind each gene's end (or, mirrored, before it inside the gene), clipped at 0."""
    size = F.explode(F.array(*[F.lit(x).cast("long") for x in lengths]))
    out = genes.withColumn("tail", size)
    behind = (F.col("strand") == "+") != F.lit(inside)
    tes = F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start"))
    s = F.when(behind, tes).otherwise(tes - F.col("tail"))
    e = F.when(behind, tes + F.col("tail")).otherwise(tes)
    return out.withColumns({"start": F.greatest(s, F.lit(0)), "end": e})


def centre_windows(df: DataFrame, centre: str, reach: int = 500, grid: int = 10) -> DataFrame:
    c = F.col(centre)
    return df.withColumns({"start": F.greatest(F.floor((c - reach) / grid) * grid, F.lit(0)), "end": F.floor((c + reach) / grid) * grid})


def sub_bins(df: DataFrame, size: int = 10) -> DataFrame:
    """Bins of each interval from its start on, numbered from 0; intervals that start below 0 are left out."""
    starts = F.sequence(F.col("start"), F.col("end") - size, F.lit(size).cast("long"))
    cols = [c for c in df.columns if c not in ("start", "end")]
    out = df.filter((F.col("start") >= 0) & (F.col("end") - F.col("start") >= size)).select(*cols, F.posexplode(starts).alias("sub", "start"))
    return out.withColumn("end", F.col("start") + size)


def tiles(chrom_sizes: DataFrame, size: int = 1000) -> DataFrame:
    """Whole tiles of each chromosome; a last partial one is left out."""
    n = F.floor(F.col("length") / size)
    out = chrom_sizes.filter(n > 0).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return out.select("chrom", (F.col("i") * size).alias("start"), ((F.col("i") + 1) * size).alias("end"))


def background(chrom_sizes: DataFrame, *excluded: DataFrame, size: int = 1000) -> DataFrame:
    """Tiles that touch none of the excluded sets."""
    taken = excluded[0].select("chrom", "start", "end")
    for x in excluded[1:]:
        taken = taken.unionByName(x.select("chrom", "start", "end"))
    return not_overlapping(tiles(chrom_sizes, size), taken, width=size)


# --- regulatory domains ----------------------------------------------------------------------------


def unique_names(genes: DataFrame, name: str = "gene") -> DataFrame:
    """Without all copies of names that occur more than once."""
    once = genes.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(name)
    return genes.join(once, name, "left_semi")


def basal_domains(genes: DataFrame, upstream: int = 5000, downstream: int = 1000) -> DataFrame:
    plus = F.col("strand") == "+"
    s = F.when(plus, F.col("start") - upstream).otherwise(F.col("end") - downstream)
    e = F.when(plus, F.col("start") + downstream).otherwise(F.col("end") + upstream)
    return genes.withColumns({"start": s, "end": e})


def distal_domains(basal: DataFrame, chrom_sizes: DataFrame, distal: int = 1_000_000) -> DataFrame:
    """Basal domains stretched by up to distal bases to their neighbours in start order, never shrunk, clipped to the chromosome.

    Genes per chromosome are few thousand by nature, so one window per chromosome is small.
    """
    order = Window.partitionBy("chrom").orderBy("start", "end", "gene")
    df = basal.join(F.broadcast(chrom_sizes), "chrom")
    before, after = F.lag("end", 1, 0).over(order), F.coalesce(F.lead("start").over(order), F.col("length"))
    df = df.withColumns({"_before": before, "_after": after})
    s = F.least("start", F.greatest(F.col("start") - distal, F.col("_before")))
    e = F.greatest("end", F.least(F.col("end") + distal, F.col("_after")))
    df = df.withColumns({"_s": F.greatest(s, F.lit(0)), "_e": F.least(e, F.col("length"))})
    return df.withColumns({"start": F.col("_s"), "end": F.col("_e")}).drop("_s", "_e", "_before", "_after", "length")


# --- annotation ------------------------------------------------------------------------------------


def signed_distances(summits: DataFrame, genes: DataFrame, window: int) -> DataFrame:
    """Distances of each summit to starts and ends of genes within the window, positive downstream."""
    points = summits.withColumns({"start": F.col("summit"), "end": F.col("summit") + 1})
    near = overlap_join(points, genes, slack=window, width=max(window, 64))
    plus = F.col("strand_b") == "+"
    first = F.when(plus, F.col("summit") - F.col("start_b")).otherwise(F.col("end_b") - F.col("summit"))
    last = F.when(plus, F.col("summit") - F.col("end_b")).otherwise(F.col("start_b") - F.col("summit"))
    return near.withColumns({"to_start": first, "to_end": last})


def annotate(a: DataFrame, catalog: DataFrame, keys: list[str], name: str = "name", slack: int = 0, default: str | None = None, width: int = 1 << 14) -> DataFrame:
    """a with the last catalogue entry (by start, end, name) that each row, known by keys, overlaps."""
    hits = overlap_join(a, catalog.select("chrom", "start", "end", name), slack=slack, width=width)
    last = hits.groupBy(*keys).agg(F.max(F.struct("start_b", "end_b", f"{name}_b")).alias("_hit"))
    out = a.join(last, keys, "left")
    value = F.col(f"_hit.{name}_b")
    return out.withColumn("annotation", F.coalesce(value, F.lit(default)) if default is not None else value).drop("_hit")


def coverage_fraction(catalog: DataFrame, allowed: DataFrame, by: str = "name", width: int = 1 << 14) -> DataFrame:
    """Per category, the share of the allowed space that lies in intervals contained in it."""
    total = allowed.agg(F.sum(F.col("end") - F.col("start")).alias("space"))
    inside = overlapping(catalog.select("chrom", "start", "end", by), allowed, within=True, width=width)
    return inside.groupBy(by).agg(F.sum(F.col("end") - F.col("start")).alias("bases")).join(F.broadcast(total)).select(by, "bases", (F.col("bases") / F.col("space")).alias("fraction"))


def linear_position(df: DataFrame, chrom_sizes: DataFrame, position: str) -> DataFrame:
    """x: position plus the lengths of the chromosomes before (chrom_sizes: chrom, length, idx)."""
    offsets = chrom_sizes.withColumn("offset", F.sum("length").over(Window.orderBy("idx")) - F.col("length")).select("chrom", "offset")
    return df.join(F.broadcast(offsets), "chrom").withColumn("x", F.col("offset") + F.col(position)).drop("offset")


def count_reads(reads: DataFrame, regions: DataFrame, width: int = 1 << 10) -> DataFrame:
    """(sample, region, cnt) of reads (sample, name, chrom, start, end) in regions (id): a read counts once in every region it touches.

    The parts of a read (its mates) share its name.
    """
    hits = overlap_join(reads, regions.select("chrom", "start", "end", "id"), width=width).select("sample", "name", F.col("id_b").alias("region")).distinct()
    return hits.groupBy("sample", "region").agg(F.count(F.lit(1)).alias("cnt"))


def signal_profile(points: DataFrame, track: DataFrame, reach: int = 5000, size: int = 10) -> DataFrame:
    """Mean signal (track: value) by offset bin around points (start), over all points; missing counts as zero."""
    n = points.count()
    around = points.select("chrom", F.col("start").alias("ref"), F.greatest(F.col("start") - reach, F.lit(0)).alias("start"), (F.col("start") + reach).alias("end"))
    hits = overlap_join(around, track.select("chrom", "start", "end", "value"), width=max(reach, 64))
    lo, hi = F.greatest("start", "start_b"), F.least("end", "end_b")
    bins = F.explode(F.sequence(F.floor((lo - F.col("ref")) / size), F.floor((hi - 1 - F.col("ref")) / size)))
    hits = hits.select("ref", lo.alias("lo"), hi.alias("hi"), "value_b", bins.alias("bin"))
    part = F.least("hi", F.col("ref") + (F.col("bin") + 1) * size) - F.greatest("lo", F.col("ref") + F.col("bin") * size)
    return hits.groupBy("bin").agg((F.sum(part * F.col("value_b")) / (size * max(n, 1))).alias("mean"))


def lift_over(df: DataFrame, blocks: DataFrame, width: int = 1 << 14, min_match: float = 0.95) -> DataFrame:
    """Maps intervals by aligned blocks (chrom, start, end, to_chrom, to_start, to_strand, to_size, chain), as read_chain() gives them.

    An interval may span blocks of one chain: it is mapped from the first to the last of its bases that are aligned, if these
    are at least the share min_match of it. Of several chains the one with most aligned bases counts, then the first.
    A strand column is turned where the target is on the reverse strand. Unmapped rows are left out; equal rows stay.
    """
    cols = [c for c in df.columns if c not in ("chrom", "start", "end")]
    blocks = blocks if "chain" in blocks.columns else blocks.withColumn("chain", F.xxhash64(*blocks.columns).cast("string"))
    hit = overlap_join(df.withColumn("_id", F.monotonically_increasing_id()), blocks, width=width)
    lo, hi = F.greatest("start", "start_b"), F.least("end", "end_b")
    plus = F.col("to_start_b") + lo - F.col("start_b")
    hit = hit.withColumn("_s", F.when(F.col("to_strand_b") == "-", F.col("to_size_b") - plus - (hi - lo)).otherwise(plus)).withColumn("_n", hi - lo)
    own = hit.groupBy("_id", "chain_b", "to_chrom_b", "to_strand_b").agg(F.sum("_n").alias("_n"), F.min("_s").alias("_from"), F.max(F.col("_s") + F.col("_n")).alias("_to"), F.first(F.struct((F.col("end") - F.col("start")).alias("_size"), *cols)).alias("_x"))
    own = own.filter(F.col("_n") >= F.col("_x._size") * min_match)
    best = own.groupBy("_id").agg(F.min_by(F.struct("to_chrom_b", "to_strand_b", "_from", "_to", "_x"), F.struct(-F.col("_n"), F.col("chain_b"))).alias("b"))
    turned = F.when(F.col("b.to_strand_b") != "-", F.col("b._x.strand")).when(F.col("b._x.strand") == "+", "-").when(F.col("b._x.strand") == "-", "+").otherwise(F.col("b._x.strand")) if "strand" in cols else None
    return best.select(F.col("b.to_chrom_b").alias("chrom"), F.col("b._from").alias("start"), F.col("b._to").alias("end"), *[turned.alias(c) if c == "strand" else F.col(f"b._x.{c}").alias(c) for c in cols])


def resampled(df: DataFrame, size: int, seed: int = 42, parts: int | None = None) -> DataFrame:
    """min(size, rows) rows of df, drawn with replacement, exactly that many, the same for a seed; none of an empty df.

    Rows are dealt to parts by their content; how many draws fall to each is one multinomial draw over the parts' counts, and
    a draw takes a place in its part by a hash. So only parts are ordered, never all rows.
    """
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64(*df.columns)
    dealt = df.withColumns({"_k": key, "_part": F.pmod(key, F.lit(parts)).cast("int")})
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().orderBy("_part").collect()}  # a row per part
    total = sum(counts.values())
    if not total:
        return df.limit(0)
    draws = np.random.default_rng(seed).multinomial(min(size, total), np.array(list(counts.values())) / total)
    plan = df.sparkSession.createDataFrame([(p, c, int(n)) for (p, c), n in zip(counts.items(), draws, strict=True) if n], "_part int, _c long, _n long")
    places = plan.select("_part", "_c", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    places = places.select("_part", F.pmod(F.xxhash64("_part", "_i", F.lit(seed)), F.col("_c")).alias("_at"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("_k")).cast("long") - 1)
    return places.join(numbered, ["_part", "_at"]).select(*df.columns)


def count_fragments(reads: DataFrame, regions: DataFrame, width: int = 1 << 10) -> DataFrame:
    """(sample, region, cnt) of reads (sample, name, mate, chrom, start, end) in regions (id): a fragment counts once in every region that one of its reads touches.

    In samples with second mates (mate 2) the reads of one name are a fragment; in the others, which were read from one end,
    each read is one. A mate whose partner is missing is a fragment of its own. Reads without a place are left out.
    """
    paired = reads.groupBy("sample").agg(F.max(F.coalesce((F.col("mate") == 2).cast("int"), F.lit(0))).alias("_paired"))
    placed = reads.filter("chrom is not null and start is not null and end is not null")
    # a row per sample: broadcast, as a join by sample would lay all reads of a sample into one task
    rows = placed.join(F.broadcast(paired), "sample").withColumn("_unit", F.when(F.col("_paired") == 1, F.col("name")).otherwise(F.monotonically_increasing_id().cast("string")))
    hits = overlap_join(rows.select("sample", "_unit", "chrom", "start", "end"), regions.select("chrom", "start", "end", "id"), width=width)
    return hits.select("sample", "_unit", F.col("id_b").alias("region")).distinct().groupBy("sample", "region").agg(F.count(F.lit(1)).alias("cnt"))


def symlog_edges(largest: float, n_bins: int, linear: float = 0.1) -> list[float]:
    """Bin edges, symmetric around 0: logarithmic beyond +-linear up to +-largest."""
    import math

    half = max(1, n_bins // 2)
    step = (math.log10(largest) - math.log10(linear)) / half
    up = [10 ** (math.log10(linear) + i * step) for i in range(half + 1)]
    return [-x for x in reversed(up)] + [0.0] + up
