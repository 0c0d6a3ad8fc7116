"""Marker sets: trims, set partitions, hierarchies and wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marker_sets(sources: dict[str, DataFrame]) -> DataFrame:
    """(set, consensus) of several tables of (set, consensus), each set named after its source."""
    out = None
    for name, df in sources.items():
        part = df.select(F.concat_ws(" ", F.lit(name), F.col("set").cast("string")).alias("set"), "consensus")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def informative(markers: DataFrame, more_than: int = 100, most_share: float = 0.1, least_sets: int = 2) -> DataFrame:
    """Large enough sets, then consensuses in at least least_sets and at most that share of them."""
    large = markers.groupBy("set").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than).select("set")
    rows = markers.join(F.broadcast(large), "set", "left_semi")
    n = large.count()
    ok = rows.groupBy("consensus").agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") >= least_sets) & (F.col("k") <= most_share * n)).select("consensus")
    return rows.join(ok, "consensus", "left_semi")


def trim(markers: DataFrame, share: float = 0.1) -> DataFrame:
    """Markers of consensuses in at most max(int(sets * share + 0.5), 1) sets."""
    most = max(int(markers.select("set").distinct().count() * share + 0.5), 1)
    ok = markers.groupBy("consensus").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= most).select("consensus")
    return markers.join(ok, "consensus", "left_semi")


def by_tissue(markers: DataFrame, tissues: DataFrame) -> DataFrame:
    """tissues (set, tissue): in how many of a tissue's sets a consensus is a marker; in all (> 0.99), half, at least two."""
    sizes = tissues.groupBy("tissue").agg(F.count_distinct("set").alias("sets"))
    k = markers.join(F.broadcast(tissues), "set").groupBy("tissue", "consensus").agg(F.count_distinct("set").alias("k"))
    out = k.join(F.broadcast(sizes), "tissue").withColumn("share", F.col("k") / F.col("sets"))
    return out.withColumns({"in_all": F.col("share") > 0.99, "in_half": F.col("share") >= 0.5, "min2": F.col("k") >= 2})


def label_list(markers: DataFrame, sep: str = ";") -> DataFrame:
    return markers.groupBy("consensus").agg(F.array_join(F.sort_array(F.collect_set("set")), sep).alias("labels"))


def wide_table(markers: DataFrame, sets: list[str], common_from: int) -> DataFrame:
    """A flag column per set, and whether at least common_from sets have the marker."""
    wide = markers.groupBy("consensus").pivot("set", sets).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumn("common", sum((F.col(f"`{s}`") for s in sets), F.lit(0)) >= common_from)


def partition(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Size of each exclusive region of a Venn diagram of boolean columns."""
    return rows.filter(" or ".join(f"`{f}`" for f in flags)).groupBy(*flags).agg(F.count(F.lit(1)).alias("size"))


def multiset_partition(rows: DataFrame, keys: str, flags: list[str]) -> DataFrame:
    """As partition() for multisets (key, count per set): each region holds what its sets share beyond the others.

    The smallest count is common to all; for two sets the rest is a - b and b - a, and likewise by inclusion for three.
    """
    import itertools

    regions = []
    for mask in itertools.product([0, 1], repeat=len(flags)):
        if not any(mask):
            continue
        inside = [F.col(f) for f, m in zip(flags, mask, strict=True) if m]
        outside = [F.col(f) for f, m in zip(flags, mask, strict=True) if not m]
        low = F.least(*inside) if len(inside) > 1 else inside[0]
        high = F.greatest(*outside) if len(outside) > 1 else (outside[0] if outside else F.lit(0))
        regions.append(F.sum(F.greatest(low - high, F.lit(0))).alias("".join(map(str, mask))))
    return rows.groupBy(keys).agg(*[F.sum(f).alias(f) for f in flags]).agg(*regions)


def upset(rows: DataFrame, flags: list[str], min_size: int = 180) -> DataFrame:
    return rows.groupBy(*flags).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size).orderBy(F.desc("size"), *flags)


def hierarchy(levels: list[tuple[str, Column]], none: str = "none") -> Column:
    """The first level whose condition holds."""
    out = None
    for name, cond in levels:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(none)


def any_share(rows: DataFrame, flags: list[str]) -> DataFrame:
    return rows.agg(F.avg(F.greatest(*[F.col(f).cast("int") for f in flags])).alias("share"))


def category_counts(rows: DataFrame, category: str, mapping: dict[str, str], total: int, remainder: str = "No overlap") -> DataFrame:
    """Counts by mapped category and, as a row of its own, what is left of the total."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
    c = F.col(category) if table is None else F.coalesce(F.element_at(table, F.col(category)), F.col(category))
    counts = rows.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    left = counts.agg((F.lit(total) - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).select(F.lit(remainder).alias("category"), "n")
    return counts.unionByName(left)


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the full product of levels, zeros included."""
    grid = rows.select(a).distinct().join(F.broadcast(rows.select(b).distinct()))
    return grid.join(rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), [a, b], "left").fillna(0, ["n"])


def detected_in(presence: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, consensus, experiments that have it).

    Rows of presence may repeat: they are told apart here, once, and needn't be before.
    """
    return presence.join(F.broadcast(categories), "experiment").groupBy("category", "consensus").agg(F.count_distinct("experiment").alias("experiments"))


def latest(rows: DataFrame, key: str, priority: Column) -> DataFrame:
    """Rows of highest priority for each key, ties kept."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(priority.desc()))).filter("_r = 1").drop("_r")


def annotated_bed(consensus: DataFrame, labels: DataFrame, palette: DataFrame, default_rgb: str = "0,0,0") -> DataFrame:
    """consensus with name = label and confidence, and the colour of the label; unlabelled ones keep their id."""
    out = consensus.join(labels, "id", "left").join(F.broadcast(palette), "label", "left")
    name = F.when(F.col("label").isNull(), F.col("id").cast("string")).otherwise(F.concat_ws("_", "label", F.col("confidence").cast("string")))
    return out.select("chrom", "start", "end", name.alias("name"), F.coalesce("rgb", F.lit(default_rgb)).alias("rgb"))
