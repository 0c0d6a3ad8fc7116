"""Set enrichment over counts: overlap counts per category, hypergeometric and binomial tests, gene-set models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import columns as fc
from ..functions import special
from .intervals import overlap_counts, overlap_join

TINY = 1e-7


def fold_change(k: Column, drawn: Column, marked: Column, total: Column) -> Column:
    return (k / F.greatest(drawn, F.lit(TINY))) / F.greatest(marked / F.greatest(total, F.lit(TINY)), F.lit(TINY))


def summits(df: DataFrame, summit: str = "summit") -> DataFrame:
    return df.withColumns({"start": F.col(summit), "end": F.col(summit) + 1})


def category_counts(catalog: DataFrame, query: DataFrame, distinct: bool = False, **options) -> DataFrame:
    """Hits of the query per catalogue name; a region counts once per entry it overlaps, or once if distinct."""
    hits = overlap_join(query, catalog.select("chrom", "start", "end", "name"), **options)
    if distinct:
        hits = hits.distinct()
    return hits.groupBy(F.col("name_b").alias("name")).agg(F.count(F.lit(1)).alias("hits"))


def vs_background(catalog: DataFrame, universe: DataFrame, in_query: Column, by: list[str] | None = None, **options) -> DataFrame:
    """Per category: n_bg hits of the universe, k_hits of the rows where in_query holds, fold change, p and q.

    One join serves the universe and the query, and with `by` all labels at once: in_query is then the label that each
    row has, and categories are tested for each label; q is over all tests.
    """
    label = by or []
    rows = universe.withColumn("_q", in_query)
    hits = overlap_join(rows, catalog.select("chrom", "start", "end", "name"), **options).withColumnRenamed("name_b", "name")
    total = universe.count()
    if label:
        sizes = rows.groupBy(*label).agg(F.count(F.lit(1)).alias("n_query"))
        n = hits.groupBy("name").agg(F.count(F.lit(1)).alias("n_bg"))
        k = hits.groupBy(*label, "name").agg(F.count(F.lit(1)).alias("k_hits"))
        grid = sizes.join(F.broadcast(n))
        out = grid.join(k, [*label, "name"], "left").fillna(0, ["k_hits"])
    else:
        drawn = rows.filter("_q").count()
        out = hits.groupBy("name").agg(F.count(F.lit(1)).alias("n_bg"), F.count_if("_q").alias("k_hits")).withColumn("n_query", F.lit(drawn).cast("long"))
    out = out.withColumn("m_total", F.lit(total).cast("long"))
    out = out.withColumn("fc", fold_change(F.col("k_hits"), F.col("n_query"), F.col("n_bg"), F.col("m_total")))
    out = out.withColumn("p", fc.hypergeom_p(F.col("k_hits"), F.col("m_total"), F.col("n_bg"), F.col("n_query")))
    return fc.bh(out, "p")


def two_sided_binomial(counts: DataFrame, k: str, n: str, p: str) -> DataFrame:
    """counts with p_value = 2 min(P(X >= k), P(X <= k-1)), which isn't capped, and q."""
    return fc.bh(counts.withColumn("p_value", fc.binom_two_sided_p(F.col(k), F.col(n), F.col(p))), "p_value")


def two_sided_classes(rows: DataFrame, cls: str, chosen: Column, top: int = 10, method: str = "bh") -> DataFrame:
    """The `top` most frequent classes among the chosen rows (ties by name), each tested in both directions against all rows.

    Of m_total rows n_query are chosen, n_bg have the class, k both; p = 2 min(P(X >= k), P(X <= k-1)), which isn't capped.
    Rows without a class count among all rows and are no class; q is over the classes returned.
    """
    counted = rows.groupBy(F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("n_bg"), F.count_if(chosen).alias("k"))
    sums = counted.agg(F.sum("n_bg").alias("m_total"), F.sum("k").alias("n_query"))
    best = counted.filter("class is not null and k > 0").orderBy(F.desc("k"), "class").limit(top)
    out = best.join(F.broadcast(sums))  # one row
    out = out.withColumn("p", fc.hypergeom_two_sided_p(F.col("k"), F.col("m_total"), F.col("n_bg"), F.col("n_query")))
    return fc.adjust(out, "p", method=method)


def tissue_markers(regions: DataFrame, marked: DataFrame, tissues: DataFrame, method: str = "bh", **options) -> DataFrame:
    """Every marker against every tissue: regions (chrom, start, end, region), of which marked (region, marker) belong to a marker, and intervals of tissues (chrom, start, end, tissue).

    k of the n_marked regions of a marker, and n_hit of all m_total regions, overlap an interval of the tissue; fc has a
    pseudo-count of 1e-9; p = P(X >= k). One interval join serves all pairs, and all pairs of a marker and a tissue are
    returned, also those without a hit. Regions count once, however often they are listed or hit. Tables with a row per
    region or interval are merged, not broadcast, and the tables of hits and of pairs are written, so each is worked out once.
    """
    regions, regions_path = session.stored(regions.select("chrom", "start", "end", "region").dropDuplicates(["region"]))
    hits = overlap_join(regions.hint("merge"), tissues.select("chrom", "start", "end", "tissue"), **options)
    hits, hits_path = session.stored(hits.select("region", F.col("tissue_b").alias("tissue")).distinct())
    marked, marked_path = session.stored(marked.select("region", "marker").distinct().join(regions.select("region").hint("merge"), "region", "left_semi"))
    sizes, each = marked.groupBy("marker").agg(F.count(F.lit(1)).alias("n_marked")), hits.groupBy("tissue").agg(F.count(F.lit(1)).alias("n_hit"))
    both = hits.join(marked.hint("merge"), "region").groupBy("marker", "tissue").agg(F.count(F.lit(1)).alias("k"))
    each = tissues.select("tissue").distinct().join(each, "tissue", "left").fillna(0, ["n_hit"])
    grid = sizes.join(each).join(both, ["marker", "tissue"], "left").fillna(0, ["k"]).join(F.broadcast(regions.agg(F.count(F.lit(1)).alias("m_total"))))
    grid = grid.withColumn("fc", ((F.col("k") + F.lit(1e-9)) / (F.col("n_marked") + F.lit(1e-9))) / ((F.col("n_hit") + F.lit(1e-9)) / (F.col("m_total") + F.lit(1e-9))))
    grid, _ = session.stored(grid.withColumn("p", fc.hypergeom_p(F.col("k"), F.col("m_total"), F.col("n_hit"), F.col("n_marked"))))
    for path in (regions_path, hits_path, marked_path):
        session.discard(regions.sparkSession, path)
    return fc.adjust(grid, "p", method=method)


def top_per_annotation(presence: DataFrame, annotation: DataFrame, alpha: float = 0.05, method: str = "bh") -> DataFrame:
    """Consensuses enriched in an annotation: presence (consensus, experiment), annotation (experiment, label); method: of the correction."""
    rows = presence.join(annotation, "experiment")
    k = rows.groupBy("consensus", "label").agg(F.count(F.lit(1)).alias("k"))
    n = rows.groupBy("consensus").agg(F.count(F.lit(1)).alias("n"))
    drawn = rows.groupBy("label").agg(F.count(F.lit(1)).alias("drawn"))
    total = rows.count()
    out = k.join(n, "consensus").join(F.broadcast(drawn), "label").withColumn("total", F.lit(total).cast("long"))
    out = out.withColumn("fc", (F.col("k") / F.col("n")) / (F.col("drawn") / F.col("total")))
    out = fc.adjust(out.withColumn("p", fc.hypergeom_p(F.col("k"), F.col("total"), F.col("n"), F.col("drawn"))), "p", by=["label"], method=method, tests=n.count())
    return out.withColumn("significant", (F.col("q") < alpha) & (F.col("k") >= 2))


def top_by_signal(values: DataFrame, annotation: DataFrame, alpha: float = 0.05, method: str = "bh") -> DataFrame:
    """As top_per_annotation(), of values > 0 (consensus, experiment, value; absent: 0): a one-sided rank test of a label's experiments against all others.

    Ranks are those within a consensus. Experiments without a value all share the ranks below, so they are counted and not
    listed. All pairs of a consensus and a label are tested. Returns consensus, label, k (of the label's experiments with a
    value), u, p, q, significant.
    """
    experiments = annotation.select("experiment", "label").dropDuplicates(["experiment"]).filter("label is not null")
    sizes, total = experiments.groupBy("label").agg(F.count(F.lit(1)).alias("n1")), experiments.count()
    rows = values.filter("value > 0").groupBy("consensus", "experiment").agg(F.max("value").alias("value")).join(experiments, "experiment")
    ranked = fc.average_rank(rows, "value", ["consensus"])
    ties = rows.groupBy("consensus", "value").agg(F.count(F.lit(1)).alias("_t")).groupBy("consensus").agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("tie"), F.sum("_t").alias("full"))
    own = ranked.groupBy("consensus", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("rank").alias("r"))
    grid = ties.join(sizes).join(own, ["consensus", "label"], "left").fillna(0, ["k", "r"])  # a row per label of each consensus
    empty, n = F.lit(total) - F.col("full"), F.lit(float(total))
    ranks = F.col("r") + F.col("k") * empty + (F.col("n1") - F.col("k")) * (empty + 1) / 2
    u = ranks - F.col("n1") * (F.col("n1") + 1) / 2
    both = F.col("n1") * (n - F.col("n1"))
    sd = F.sqrt(both / 12 * ((n + 1) - (F.col("tie") + empty * empty * empty - empty) / (n * (n - 1))))
    out = grid.withColumns({"u": u, "p": F.when((both > 0) & (sd > 0), fc.norm_p((u - both / 2 - 0.5) / sd)).otherwise(1.0)})
    out = fc.adjust(out.select("consensus", "label", "k", "u", "p"), "p", by=["label"], method=method)
    return out.withColumn("significant", (F.col("q") < alpha) & (F.col("k") >= 2))


def composition(members: DataFrame, fixed: bool = True) -> DataFrame:
    """members (cluster, label): share of each label that falls in the cluster, normalised per cluster, and FC vs others.

    fixed=False divides by the mean of all labels, the given one included.
    """
    share = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).join(members.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label")
    each = Window.partitionBy("cluster")
    share = share.withColumn("part", F.col("k") / F.col("size"))
    share = share.withColumn("share", F.col("part") / F.sum("part").over(each))
    labels = members.select("label").distinct().count()
    others = (F.sum("share").over(each) - F.col("share")) / max(labels - 1, 1) if fixed else F.sum("share").over(each) / max(labels, 1)
    return share.withColumn("fc_vs_others", F.col("share") / others)


def diversity(presence: DataFrame, annotation: DataFrame) -> DataFrame:
    """Per consensus: dominant label, normalised entropy and Gini impurity of label shares."""
    rows = presence.join(annotation, "experiment")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    labels = annotation.select("label").distinct().count()
    part = rows.groupBy("consensus", "label").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(sizes), "label").withColumn("w", F.col("k") / F.col("size"))
    p = part.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("consensus")))
    top = -math.log(1 / labels + 1e-15)
    return p.groupBy("consensus").agg(
        F.max_by("label", F.struct("p", "label")).alias("dominant"),
        (-F.sum(F.col("p") * F.log(F.col("p") + 1e-15)) / top).alias("entropy"),
        (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"),
    )


def specificity(members: DataFrame, value: str, top: int = 5) -> DataFrame:
    """members (cluster, label, value): mean inside the cluster over mean outside, the best labels of each cluster."""
    each = members.groupBy("cluster", "label").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    w = Window.partitionBy("label")
    out = each.withColumn("specificity", (F.col("s") / F.col("c")) / ((F.sum("s").over(w) - F.col("s")) / (F.sum("c").over(w) - F.col("c"))))
    order = Window.partitionBy("cluster").orderBy(F.desc("specificity"), "label")
    return out.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("s", "c")


def state_shares(states: DataFrame) -> DataFrame:
    """states (consensus, epigenome, state, in_cluster): paired difference of state shares over epigenomes."""
    own, all_ = Window.partitionBy("epigenome", "in_cluster"), ["epigenome", "in_cluster", "state"]
    part = states.groupBy(*all_).agg(F.count(F.lit(1)).alias("k")).withColumn("share", F.col("k") / F.sum("k").over(own))
    pair = part.groupBy("state", "epigenome").agg(F.sum(F.when(F.col("in_cluster"), F.col("share")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("in_cluster"), F.col("share")).otherwise(0.0)).alias("b"))
    out = pair.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("d"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd"), F.log2(F.avg("a") / F.avg("b")).alias("log2_fc"))
    out = out.withColumn("t", F.col("d") / (F.col("sd") / F.sqrt("n")))
    return out.withColumn("p", F.when((F.col("n") > 1) & (F.col("sd") > 0), 2 * fc.t_p(F.abs("t"), F.greatest(F.col("n") - 1, F.lit(1)))))


def concordance(a: DataFrame, b: DataFrame, universe: int, top: int) -> DataFrame:
    """a, b (feature, p): the top features of both, their overlap, recall, precision, fold change and P(X >= overlap)."""
    ta, tb = (x.orderBy("p", "feature").limit(top).select("feature") for x in (a, b))
    both = ta.intersect(tb).agg(F.count(F.lit(1)).alias("both"))
    out = both.join(ta.agg(F.count(F.lit(1)).alias("n_a"))).join(tb.agg(F.count(F.lit(1)).alias("n_b"))).withColumn("total", F.lit(universe).cast("long"))
    out = out.withColumns({"recall": F.col("both") / F.col("n_b"), "precision": F.col("both") / F.col("n_a"), "fc": F.col("both") * F.col("total") / (F.col("n_a") * F.col("n_b"))})
    return out.withColumn("p", fc.hypergeom_p(F.col("both"), F.col("total"), F.col("n_a"), F.col("n_b")))


def cohort_threshold(significant: DataFrame, features: int, reps: int = 100, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """significant (feature, cohort): null of "significant in >= t cohorts" by shuffling every cohort's features.

    A shuffled cohort of size s marks s random features out of `features`; drawn by a hash order per (rep, cohort).
    Returns t, observed, expected, fpr = expected / (observed + expected).
    """
    spark = significant.sparkSession
    sizes = significant.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    grid = spark.range(features).withColumnRenamed("id", "f").join(F.broadcast(sizes.join(spark.range(reps).withColumnRenamed("id", "rep"))))
    order = Window.partitionBy("rep", "cohort").orderBy(F.xxhash64("f", "rep", "cohort", F.lit(seed)), "f")
    drawn = grid.withColumn("r", F.row_number().over(order)).filter("r <= size")
    null = drawn.groupBy("rep", "f").agg(F.count(F.lit(1)).alias("t")).groupBy("t").agg((F.count(F.lit(1)) / reps).alias("e"))
    seen = significant.groupBy("feature").agg(F.count(F.lit(1)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("o"))
    down = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)  # one row per number of cohorts
    out = seen.join(null, "t", "full_outer").fillna(0, ["o", "e"])
    out = out.select("t", F.sum("o").over(down).alias("observed"), F.sum("e").over(down).alias("expected"))
    return out.withColumn("fpr", F.col("expected") / (F.col("observed") + F.col("expected"))).withColumn("passes", F.col("fpr") < alpha)


# --- gene sets --------------------------------------------------------------------------------------


def nb1_glm(hits: np.ndarray, expected: np.ndarray, member: np.ndarray) -> tuple[float, float]:
    """(p, beta): mean expected * exp(beta * member + b0), variance mean * (1 + a); Wald, one-sided by beta's sign."""
    keep = expected > 0
    y, e, x = hits[keep].astype(float), expected[keep], member[keep].astype(float)
    if not len(y) or x.sum() == 0 or x.sum() == len(x) or y.sum() == 0:
        return math.nan, math.nan
    lg = special.lgamma
    fixed = lg(y + 1)

    def nll(t: np.ndarray) -> float:
        mu, a = e * np.exp(np.clip(t[0] * x + t[1], -50, 50)), math.exp(min(30.0, max(-9.0, t[2])))  # with less the log-gammas' difference is rounding, and a Poisson model as good
        r = mu / a
        return -float(np.sum(lg(y + r) - lg(r) - fixed - r * math.log1p(a) + y * (t[2] - math.log1p(a))))

    step_size = 1e-4

    def slope(t: np.ndarray, h: float = step_size) -> tuple[np.ndarray, np.ndarray]:
        g, m, f0 = np.zeros(3), np.zeros((3, 3)), nll(t)
        d = np.eye(3) * h
        up, down = [nll(t + d[i]) for i in range(3)], [nll(t - d[i]) for i in range(3)]
        for i in range(3):
            g[i], m[i, i] = (up[i] - down[i]) / (2 * h), (up[i] - 2 * f0 + down[i]) / h**2
            for j in range(i):
                m[i, j] = m[j, i] = (nll(t + d[i] + d[j]) - nll(t + d[i] - d[j]) - nll(t - d[i] + d[j]) + nll(t - d[i] - d[j])) / (4 * h * h)
        return g, m

    t = np.array([0.0, math.log(max(y.sum(), 1e-9) / e.sum()), 0.0])
    for _ in range(60):  # damped Newton
        g, m = slope(t)
        w, v = np.linalg.eigh(m)
        step = v @ ((v.T @ g) / np.maximum(np.abs(w), 1e-4))
        size = 1.0
        while size > 1e-6 and nll(t - size * step) > nll(t):
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    m = slope(t)[1]
    if m[2, 2] < 100 * np.finfo(float).eps * max(1.0, abs(nll(t))) / step_size**2:  # no more than rounding: without dispersion nothing depends on it
        m = m[:2, :2]
    cov = np.linalg.pinv(m)
    if cov[0, 0] <= 0:
        return math.nan, float(t[0])
    p = 2 * special.norm_sf(abs(t[0]) / math.sqrt(cov[0, 0]))
    return (p / 2 if t[0] >= 0 else 1 - p / 2), float(t[0])


class GeneSetEnricher:
    """Gene sets (term, name, gene) tested on regions through regulatory domains (gene, chrom, start, end)."""

    def __init__(self, gene_sets: DataFrame, domains: DataFrame, chrom_sizes: DataFrame):
        self.gene_sets, self.domains, self.chrom_sizes = gene_sets, domains, chrom_sizes

    def _hits(self, regions: DataFrame) -> DataFrame:
        return overlap_counts(regions, self.domains.select("chrom", "start", "end", "gene"), "gene").withColumnRenamed("n", "hits")

    def genes(self, query: DataFrame, background: DataFrame) -> DataFrame:
        """Each gene's domain tested for hits of the query among those of the background."""
        k, n = self._hits(query).withColumnRenamed("hits", "k_hits"), self._hits(background).withColumnRenamed("hits", "n_bg")
        out = n.join(k, "gene", "left").fillna(0, ["k_hits"]).withColumns({"m_total": F.lit(background.count()).cast("long"), "n_query": F.lit(query.count()).cast("long")})
        out = out.withColumn("fc", fold_change(F.col("k_hits"), F.col("n_query"), F.col("n_bg"), F.col("m_total")))
        return fc.bh(out.withColumn("p", fc.hypergeom_p(F.col("k_hits"), F.col("m_total"), F.col("n_bg"), F.col("n_query"))), "p").orderBy("p", "gene")

    def genes_of(self, term: str, tested: DataFrame, alpha: float = 0.05) -> DataFrame:
        return tested.filter(F.col("q") < alpha).join(self.gene_sets.filter(F.col("term") == term).select("gene").distinct(), "gene", "left_semi")

    def exposures(self, query: DataFrame, background: DataFrame | None = None) -> DataFrame:
        """gene, hits of the query in its domains, and expected: those of the background, scaled to the query's size, or the domains' share of the genome times that size."""
        n_query = query.count()
        if background is None:
            genome = self.chrom_sizes.agg(F.sum("length")).first()[0]
            part = F.sum(F.greatest((F.col("end") - F.col("start")) / genome, F.lit(1 / genome))) * n_query
            expected = self.domains.groupBy("gene").agg(part.alias("expected"))
        else:
            expected = self._hits(background).select("gene", (F.col("hits") * (n_query / max(background.count(), 1))).alias("expected"))
        return expected.join(self._hits(query), "gene", "left").fillna(0, ["hits"])

    def find_enriched(self, query: DataFrame, background: DataFrame | None = None, min_genes: int = 3, max_genes: int = 1000) -> DataFrame:
        """Terms by an NB1 regression of each gene's hits on membership, with the expected hits as exposure.

        Terms of fewer than min_genes hit genes or more than max_genes are left out before the fits, and so are fits without
        an error. Three arrays of all genes are broadcast, if any term is left; a task holds them and one term's genes.
        """
        spark = query.sparkSession
        genes, path = session.stored(self.exposures(query, background))
        sets = self.gene_sets.select("term", "name", "gene").distinct().join(genes.select("gene", "hits"), "gene")
        sizes = sets.groupBy("term").agg(F.count(F.lit(1)).alias("_genes"), F.count_if(F.col("hits") > 0).alias("_hit"))
        sizes = sizes.filter((F.col("_hit") >= min_genes) & (F.col("_genes") <= max_genes)).select("term")
        sets, sets_path = session.stored(sets.join(sizes, "term", "left_semi"))
        schema = "term string, name string, p double, beta double, total_hits double"
        if sets.isEmpty():
            out = spark.createDataFrame([], schema)
        else:
            listed = genes.select("gene", "hits", "expected").toPandas().sort_values("gene")
            vectors = spark.sparkContext.broadcast((listed["gene"].to_numpy(), listed["hits"].to_numpy(float), listed["expected"].to_numpy(float)))

            def fit(pdf: pd.DataFrame) -> pd.DataFrame:
                names, h, e = vectors.value
                own = np.searchsorted(names, pdf["gene"].to_numpy())
                member = np.zeros(len(h))
                member[own] = 1
                p, beta = nb1_glm(h, e, member)
                return pd.DataFrame({"term": [pdf["term"].iloc[0]], "name": [pdf["name"].iloc[0]], "p": [max(p, 1e-320) if p == p else p], "beta": [beta], "total_hits": [float(h[own].sum())]})

            out, _ = session.stored(sets.groupBy("term").applyInPandas(fit, schema).filter("p is not null and not isnan(p)"))
        for x in (path, sets_path):
            session.discard(spark, x)
        out = fc.bh(out, "p")
        return out.withColumns({"fc": F.exp("beta"), "neg_log10_q": -F.log10("q")}).orderBy("p", "term")


    def find_enriched_binomial(self, query: DataFrame, background: DataFrame, min_genes: int = 3, max_genes: int = 1000) -> DataFrame:
        """Terms by a binomial regression: of a gene's hits by query or background, those by the query, on membership.

        With one indicator and an intercept the likelihood has its maximum where both groups have their own shares, so one
        aggregation over (gene, term) fits all terms: beta is the difference of the groups' log odds, and its variance the
        sum of the reciprocals of the four counts. Neither genes nor terms pass through the driver. Terms in which a count
        is zero have no finite estimate and are left out, as those of fewer than min_genes hit genes or more than max_genes.
        p: Wald, one-sided by beta's sign. Returns term, name, beta, se, p, total_hits, q, fc, neg_log10_q, by p and term.
        """
        inside, outside = self._hits(query).withColumnRenamed("hits", "k"), self._hits(background).withColumnRenamed("hits", "other")
        genes = inside.join(outside, "gene", "full").fillna(0, ["k", "other"])
        sums = genes.agg(F.sum("k").alias("_k"), F.sum("other").alias("_o"))
        sets = self.gene_sets.select("term", "name", "gene").distinct().join(self.domains.select("gene").distinct(), "gene", "left_semi")
        own = sets.join(genes, "gene", "left").groupBy("term").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("genes"), F.count_if(F.col("k") > 0).alias("hit"), F.coalesce(F.sum("k"), F.lit(0)).alias("k1"), F.coalesce(F.sum("other"), F.lit(0)).alias("o1"))
        rest = own.filter((F.col("hit") >= min_genes) & (F.col("genes") <= max_genes)).join(F.broadcast(sums))  # one row
        rest = rest.withColumns({"k0": F.col("_k") - F.col("k1"), "o0": F.col("_o") - F.col("o1")}).filter("k1 > 0 and o1 > 0 and k0 > 0 and o0 > 0")
        beta = F.log(F.col("k1") / F.col("o1")) - F.log(F.col("k0") / F.col("o0"))
        rest = rest.withColumns({"beta": beta, "se": F.sqrt(1 / F.col("k1") + 1 / F.col("o1") + 1 / F.col("k0") + 1 / F.col("o0"))})
        out = rest.select("term", "name", "beta", "se", F.greatest(fc.norm_p(F.col("beta") / F.col("se")), F.lit(1e-320)).alias("p"), F.col("k1").alias("total_hits"))
        return fc.bh(out, "p").withColumns({"fc": F.exp("beta"), "neg_log10_q": -F.log10("q")}).orderBy("p", "term")


def top_terms(enriched: DataFrame, alpha: float = 0.05, min_fc: float = 1.0, top: int = 10) -> DataFrame:
    return enriched.filter((F.col("q") < alpha) & (F.col("fc") > min_fc)).orderBy(F.desc("fc"), "term").limit(top)


def representatives(enriched: DataFrame, clusters: DataFrame, score: str = "neg_log10_q") -> DataFrame:
    """The term of highest score in each cluster (term, cluster)."""
    return enriched.join(clusters, "term").groupBy("cluster").agg(F.max_by("name", F.struct(score, "name")).alias("representative"), F.max(score).alias("score"))
