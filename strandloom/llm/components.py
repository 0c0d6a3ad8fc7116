"""Connected components: within tasks first, then by alternating large and small stars, all in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


ROWS = 1 << 19  #: edges that a task reads


def _sized(edges: DataFrame, n: int) -> DataFrame:
    """Saved edges, n of them, in as few partitions as their number needs: tasks follow the data, not its history."""
    return edges.coalesce(max(1, -(-n // ROWS)))


def _within(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars (u, v): its nodes under the least of those they hang together with there."""

    def run(batches):
        root: dict[int, int] = {}
        for b in batches:
            for x, y in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
                x, y = find(root, root.setdefault(x, x)), find(root, root.setdefault(y, y))
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = [x for x in root if root[x] != x]
        for at in range(0, len(nodes), 1 << 16):
            some = nodes[at : at + (1 << 16)]
            yield {"u": np.array(some, np.int64), "v": np.array([find(root, x) for x in some], np.int64)}

    return shared.stream(edges, run, "u long, v long")


def find(root: dict[int, int], x: int) -> int:
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def _stars(both: DataFrame) -> DataFrame:
    """Of neighbours (u, v), each with m, the least node of u and its neighbours."""
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame, tables: shared.Tables | None = None) -> DataFrame:
    """(node, label) of every node in edges (u, v: long), label being the least node of its component.

    Edges with a null end and loops are left out (a node that only these hold is in no row), repeats change nothing,
    an empty table gives no rows. Each task turns the edges it reads, at most ROWS, into stars; one task's are the
    result. Of several tasks' stars a step hangs the larger neighbours of each node under the least (large star), then
    the smaller ones (small star); a node with many neighbours is first aggregated partially and then joined, never
    gathered. Steps repeat until nothing changes, of the order of log(nodes) times, and each goes to the shared folder
    (to tables, where given; its result is then the caller's to drop).
    """
    tables = tables or shared.Tables(edges.sparkSession, "components")
    raw = tables.save(edges.filter("u <> v").select("u", "v"))
    n = raw.count()
    edges = tables.save(_within(_sized(raw, n)))
    tables.drop(raw)
    whole, seen, table = n <= ROWS, None, edges
    while not whole:
        large = _stars(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = large.distinct()
        small = _stars(small).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = tables.save(small)
        tables.drop(table)
        state = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        whole, seen, table, edges = state == seen, state, new, _sized(new, state[0])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
