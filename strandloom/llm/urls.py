"""URL filters: path rules first, then trust and distrust that spread over the links between hosts.

Hosts whose pages mostly fall under allowing (blocking) rules are trusted (blocked) seeds. Trust is a
personalised PageRank from the trusted seeds along links; distrust is one from the blocked seeds against them: a host
that links to blocked hosts earns distrust. Each host is judged by both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Of a host and its subdomains, the paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def links(pages: DataFrame) -> DataFrame:
    """Host edges (src, dst, weight: links) of absolute and scheme-relative addresses in href and src attributes."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""), F.lit(1))
    out = pages.select("host", F.explode(found).alias("to"))
    dst = F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), UPPER, LOWER)
    return out.select(F.col("host").alias("src"), dst.alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank (host, mass) from seeds (host, mass; summing to one) along edges (src, dst, share).

    Mass is joined to the edges by host and summed by target before the shuffle; every second round goes to
    the shared folder, so that the plan stays short and a lost executor costs two rounds. From the seeds alone, mass only
    grows, so the growth of its sum is the summed change: rounds end when two of them add at most tolerance, which takes
    log(tolerance) / log(damping) rounds at most.
    """
    start = seeds.select("host", (F.col("mass") * (1 - damping)).alias("mass"))
    now, total = start, 0.0
    while True:
        for _ in range(2):
            moved = now.join(edges, now["host"] == edges["src"]).select(F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
            now = start.unionByName(moved).groupBy("host").agg(F.sum("mass").alias("mass"))
        now = shared.saved(now)
        before, total = total, now.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
        if total - before <= tolerance:
            return now


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, margin: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """One row per row of pages (page_id, url, html): host, path, the longest rule that fits, and a verdict.

    The verdict is the rule's; without a rule a host is blocked if its distrust exceeds margin times its trust, and
    allowed otherwise (so also if no seed reaches it). Both are iterated until they change by at most tolerance. A null url or one without :// has an empty host and path, which no
    rule fits and no link reaches; null html has no links. Equal rows are judged alike, and an empty table gives no rows.
    Other columns are ignored. Rules of equal length that both fit: the first in alphabetic order.

    Returns page_id, host, path, rule, verdict, trust, distrust.
    """
    use = sorted(rules, key=lambda r: (-len(r.text), r.text))
    host, path = F.col("host"), F.col("path")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule = verdict = None
    for r in use:
        ok = r.fits(host, path)
        rule = F.when(ok, r.text) if rule is None else rule.when(ok, r.text)
        verdict = F.when(ok, r.verdict) if verdict is None else verdict.when(ok, r.verdict)
    none = F.lit(None).cast("string")
    parsed = parsed.withColumns({"rule": none if rule is None else rule, "ruled": none if verdict is None else verdict})
    hosts = shared.saved(parsed.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")).filter("host <> ''"))
    edges = shared.saved(links(parsed))
    mass = {}
    for name, own, a, b in (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src")):
        seeds = hosts.filter(F.col(own) * 2 > F.col("n"))
        seeds = seeds.select("host", F.lit(1 / max(1, seeds.count())).alias("mass"))
        sums = edges.groupBy(F.col(a).alias("a")).agg(F.sum("weight").alias("out"))
        way = edges.join(sums, edges[a] == sums["a"]).select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("weight") / F.col("out")).alias("share"))
        mass[name] = spread(shared.saved(way), shared.saved(seeds), damping, tolerance).select(F.col("host").alias(f"{name}_host"), F.col("mass").alias(name))
    scored = mass["trust"].join(mass["distrust"], F.col("trust_host") == F.col("distrust_host"), "full_outer")
    scored = shared.saved(scored.select(F.coalesce("trust_host", "distrust_host").alias("scored"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    out = parsed.drop("html").join(scored, parsed["host"] == scored["scored"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    spread_verdict = F.when(distrust > trust * margin, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", spread_verdict).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
