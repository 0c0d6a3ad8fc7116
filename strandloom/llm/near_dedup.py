"""MinHash near-dedup with an LSH forest.

Documents with equal shingle sets form a class. Each tree of the forest sorts the classes by its own order of
signature values: `depth` whole values, then the low bytes of the others, begun elsewhere in each tree. Rows that share
at least the whole values are candidates of each other, unless their sketches rule that out. As rows are sorted, those
with the longest common prefix are nearest, and a window of neighbours goes as deep as a region is crowded. Where more
rows share a prefix than the window spans, what it may miss is found exactly: two linked sets share one of their
rarest shingles, so the classes of such regions are joined by these. Candidates hang together in groups; each group is
compared in full, on full sets, as far as confirmed links have not joined it by then, and confirmed links give components.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared, windows
from .decontaminate import shingle_hashes
from .substring_dedup import WordHashes

U = np.uint64
SKETCH = 64
MAYBE = 36  # equal sketch bytes of 64; at a similarity of 0.8 fewer have a probability of 5e-6
ROW = "tree int, key long, sketch binary, n long, c long"


def _sets(texts: list[bytes], known: WordHashes, n: int):
    for t in texts:
        yield np.unique(shingle_hashes(known.of(t.lower().split()), n))


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(U).max, U)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, (s[None, at : at + 4096] * a[:, None] + b[:, None]).min(1))
    return (out >> U(32)).astype(np.uint32)


def _signed(values: np.ndarray) -> bytes:
    """The values and, behind them, the sketch: the low bytes of the first."""
    return values.tobytes() + values[:SKETCH].astype(np.uint8).tobytes()


def _documents(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """doc_id, rk, n, hi, lo (of the set's 128-bit hash) and, for non-empty sets, the signature."""
    values = windows.mix(np.arange(1, 2 * trees * depth + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    a, b = values[::2] | U(1), values[1::2]

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, len(batch["text"]), 1024):
                out = {"doc_id": batch["doc_id"].slice(at, 1024), "rk": batch["rk"].slice(at, 1024), "n": [], "hi": [], "lo": [], "sig": []}
                if len(known) > 1 << 19:
                    known = WordHashes()
                for s in _sets(shared.as_bytes(batch["text"].slice(at, 1024)), known, n):
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    out["n"].append(len(s))
                    out["hi"].append((h >> 64) - (1 << 63))
                    out["lo"].append((h & (2**64 - 1)) - (1 << 63))
                    out["sig"].append(_signed(_signature(s, a, b)) if len(s) else None)
                yield out

    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    return shared.stream(docs, run, f"doc_id {kind}, rk long, n long, hi long, lo long, sig binary")


def _pairs(rows: dict[str, np.ndarray], lags: int, n_old: int, share: float) -> dict[str, np.ndarray]:
    """Candidates among sorted rows; those of the first n_old rows with each other are left out.

    Next neighbours that may be alike chain up; pairs further apart are given only if no chain joins them already.
    """
    k, n, sk = len(rows["c"]), rows["n"].astype(np.float64), rows["sketch"]
    a, b = [], []
    chain = np.arange(k)
    for lag in range(1, min(lags, k - 1) + 1):
        i = np.flatnonzero((rows["tree"][lag:] == rows["tree"][:-lag]) & (rows["key"][lag:] == rows["key"][:-lag]) & (chain[lag:] != chain[:-lag]))
        i = i[np.minimum(n[i], n[i + lag]) >= share * np.maximum(n[i], n[i + lag])]
        same = rows["c"][i] == rows["c"][i + lag]
        ok = [j[same[at : at + len(j)] | ((sk[j] == sk[j + lag]).sum(1) >= MAYBE)] for at in range(0, len(i), 1 << 16) for j in (i[at : at + (1 << 16)],)]
        i = np.concatenate([np.zeros(0, np.int64), *ok])
        if lag == 1:
            new = np.ones(k, bool)
            new[i + 1] = False
            chain = np.cumsum(new)
        i = i[(i + lag >= n_old) & (rows["c"][i] != rows["c"][i + lag])]
        a.append(rows["c"][i])
        b.append(rows["c"][i + lag])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    return {"a": np.minimum(a, b), "b": np.maximum(a, b)}


def _columns(b: dict) -> dict[str, np.ndarray]:
    flat = np.frombuffer(b"".join(shared.as_bytes(b["sketch"])), np.uint8).reshape(-1, SKETCH)
    return {c: np.asarray(b[c]) for c in ("tree", "key", "n", "c")} | {"sketch": flat}


def _rows(classes: DataFrame, some: range, trees: int, depth: int) -> DataFrame:
    """A row for each class with a signature and each of some trees: tree, key (its prefix), sketch, n, c."""
    width = depth * 4
    t = F.col("tree")
    sketch = F.expr(f"substring(sig, {trees * width + 1}, {SKETCH})")
    turn = (t * 13) % SKETCH
    rows = classes.filter("sig is not null").select("c", "n", "sig", F.explode(F.array(*map(F.lit, some))).alias("tree"))
    return rows.select("tree", F.xxhash64(t, F.substring("sig", t * width + 1, F.lit(width))).alias("key"), F.concat(F.substring(sketch, turn + 1, F.lit(SKETCH)), F.substring(sketch, F.lit(1), turn)).alias("sketch"), "n", "c")


def crowded(joined: DataFrame, trees: int, depth: int, lags: int) -> DataFrame:
    """(c, g, n, sketch) of classes with a prefix, in any tree, that more rows share than the window spans, of several g."""
    width = depth * 4
    t = F.col("tree")
    sketch = F.expr(f"substring(sig, {trees * width + 1}, {SKETCH})")
    rows = joined.filter("sig is not null").select("c", "g", "sig", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"))
    rows = rows.select("c", "g", F.xxhash64(t, F.substring("sig", t * width + 1, F.lit(width))).alias("key"))
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("g").alias("a"), F.max("g").alias("b"))
    mixed = mixed.filter((F.col("rows") > lags + 1) & (F.col("a") < F.col("b"))).select("key")
    return joined.join(rows.join(mixed, "key", "left_semi").select("c").distinct(), "c", "left_semi").select("c", "g", "n", sketch.alias("sketch"))


def _rarest(items: np.ndarray, held: list[windows.Sketch], percent: int) -> np.ndarray:
    """Of a set, the first shingles in an order that is the same for all sets: rare ones first, then by hash.

    They are so many that any set linked to this one holds one of them among its own first ones. What no other set
    holds is left out.
    """
    level = np.sum([h.passes(items) for h in held], 0)
    first = np.lexsort((items, level))[: len(items) + 1 - -(-percent * len(items) // 100)]
    return items[first[level[first] > 0]]


def by_rare_shingles(docs: DataFrame, some: DataFrame, words: int, percent: int, tables: shared.Tables, often: int = 32, block: int = 4096) -> DataFrame:
    """(a, b): the g of classes (some: hi, lo, c, g, n, sketch) that may be linked, g being different: exact but for the sketch.

    Only classes that share one of their rarest shingles meet. Under a shingle that many share, those outside the
    largest g are compared with all, blocks with blocks, so no task holds them all.
    """
    sets = tables.save(_full(docs, some, words, tables.spark).join(some, ["hi", "lo"]).select("c", "g", "n", "sketch", "items"))
    total = some.agg(F.sum("n")).first()[0] or 0
    width = min(28, max(16, int(total).bit_length() + 2))

    def shingles(batches):
        for b in batches:
            for x in shared.as_bytes(b["items"]):
                yield np.frombuffer(x, U)

    spread = docs.sparkSession.sparkContext.broadcast([windows.merged_sketch(sets.select("items"), shingles, n, width, 1) for n in (2, often)])

    def rare(batches):
        for b in batches:
            for at in range(0, len(b["c"]), 256):
                part = {c: v.slice(at, 256) for c, v in b.items()}
                got = [_rarest(np.frombuffer(x, U), spread.value, percent) for x in shared.as_bytes(part["items"])]
                of = np.repeat(np.arange(len(got)), [len(x) for x in got])
                yield {"token": np.concatenate([np.zeros(0, U), *got]).view(np.int64)} | {c: part[c].take(of) for c in ("g", "n", "sketch")}

    rows = tables.save(shared.stream(sets, rare, "token long, g long, n long, sketch binary"))
    tables.drop(sets)
    each = rows.groupBy("token", "g").agg(F.count(F.lit(1)).alias("rows"))
    sizes = each.groupBy("token").agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "g")).alias("most")).filter("rows > most.rows")
    sizes = sizes.select("token", F.col("most.g").alias("main"), F.ceil(F.col("rows") / block).alias("lists"), F.ceil((F.col("rows") - F.col("most.rows")) / block).alias("asks"))
    rows = tables.save(rows.join(sizes, "token"))
    buckets = max(1, -(-rows.count() // (1 << 16)))
    listed, asked = _dealt(rows, "token", F.col("g") != F.col("main"), F.xxhash64("sketch", "g"))
    k = F.xxhash64("token", "list", "ask")
    left, right = (x.select(k.alias("k"), "g", "n", "sketch").withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets))) for x in (listed, asked))

    def compare(left, right):
        import pandas as pd

        return pd.DataFrame(shared.relieved(_meeting)(left, right, percent / 100))

    return tables.save(left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(compare, "a long, b long"))


def _dealt(rows: DataFrame, region: str, outside, salt) -> tuple[DataFrame, DataFrame]:
    """Rows (region, lists, asks) as listed and as asking: each row outside the main part meets each of its region once, under (region, list, ask)."""
    listed = rows.withColumn("list", F.pmod(salt, F.col("lists"))).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)))
    asked = rows.filter(outside).withColumn("ask", F.pmod(salt, F.col("asks"))).withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1)))
    return listed, asked


def _meeting(left, right, share: float) -> dict[str, np.ndarray]:
    """(a, b): different g of rows (k, g, n, sketch) that share k, are alike in size and agree in their sketches."""
    def columns(x):
        x = x.sort_values("k", kind="stable")
        return x["k"].to_numpy(), x["g"].to_numpy(), x["n"].to_numpy(), np.frombuffer(b"".join(x["sketch"]), np.uint8).reshape(-1, SKETCH)

    (k, g, n, s), (ok, og, on, os_) = columns(left), columns(right)
    first = np.searchsorted(k, ok, "left")
    count = np.searchsorted(k, ok, "right") - first
    upto = np.concatenate([[0], np.cumsum(count)])
    out = [np.zeros((0, 2), np.int64)]
    at = 0
    while at < len(ok):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 17), "right")) - 1)
        c = count[at:end]
        j = np.repeat(np.arange(at, end), c)
        i = np.arange(len(j)) - np.repeat(upto[at:end] - upto[at], c) + first[j]
        near = (g[i] != og[j]) & (np.minimum(n[i], on[j]) >= share * np.maximum(n[i], on[j]))
        i, j = i[near], j[near]
        near = (s[i] == os_[j]).sum(1) >= MAYBE
        out.append(np.unique(np.stack([np.minimum(g[i], og[j]), np.maximum(g[i], og[j])], 1)[near], axis=0))
        at = end
    a, b = np.unique(np.concatenate(out), axis=0).T
    return {"a": a, "b": b}


def _full(docs: DataFrame, classes: DataFrame, words: int, spark) -> DataFrame:
    """(hi, lo, items): the full sets of these classes (hi, lo), one row each; a few others may be among them."""

    def numbers(batches):
        for b in batches:
            yield np.asarray(b["hi"]).view(U)

    sketch = spark.sparkContext.broadcast(windows.merged_sketch(classes.select("hi"), numbers, 1, 26, 1))

    def full(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, len(batch["text"]), 1024):
                if len(known) > 1 << 19:
                    known = WordHashes()
                out, have = {"hi": [], "lo": [], "items": []}, set()
                for s in _sets(shared.as_bytes(batch["text"].slice(at, 1024)), known, words):
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    if h not in have:
                        have.add(h)
                        out["hi"].append((h >> 64) - (1 << 63))
                        out["lo"].append((h & (2**64 - 1)) - (1 << 63))
                        out["items"].append(s.tobytes())
                ok = sketch.value.passes(np.array(out["hi"], np.int64).view(U))
                yield {c: [x for x, k in zip(v, ok.tolist(), strict=True) if k] for c, v in out.items()}

    return shared.stream(docs.select("text"), full, "hi long, lo long, items binary").groupBy("hi", "lo").agg(F.first("items").alias("items"))


def candidates(rows: DataFrame, lags: int, share: float, tables: shared.Tables) -> DataFrame:
    """(a, b): the c of rows that a tree holds near each other and whose sketches agree enough, a < b; as many as join them.

    Rows are dealt by ranges of each tree's order, in which a large group of look-alikes is spread by its
    deeper values. What lies at the ends of a partition is compared with its neighbour's in a second, small step.
    """
    order = ["tree", "key", "sketch", "c"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part = TaskContext.get().partitionId()
        hold = first = None
        for b in batches:
            new = _columns(b)
            old = 0 if hold is None else len(hold["c"])
            both = new if hold is None else {c: np.concatenate([hold[c], new[c]]) for c in new}
            for at in range(0, max(1, len(both["c"])), 1 << 16):
                piece = {c: v[max(0, at - lags) : at + (1 << 16)] for c, v in both.items()}
                yield out(_pairs(piece, lags, old if at == 0 else min(lags, at), share))
            hold = {c: v[-lags:] for c, v in both.items()}
            if first is None or len(first["c"]) < lags:
                first = {c: (v if first is None else np.concatenate([first[c], v]))[:lags] for c, v in new.items()}
        if hold is not None:
            for at, x in ((part, hold), (part - 1, first)):
                yield {"a": [None] * len(x["c"]), "b": [None] * len(x["c"]), "edge": [at] * len(x["c"]), "tree": x["tree"], "key": x["key"], "sketch": [s.tobytes() for s in x["sketch"]], "n": x["n"], "c": x["c"]}

    def out(p):
        none = [None] * len(p["a"])
        return p | {c: none for c in ("edge", "tree", "key", "sketch", "n", "c")}

    found = tables.save(shared.stream(rows, run, f"a long, b long, edge int, {ROW}"))

    def across(pdf):
        pdf = pdf.drop_duplicates(["tree", "key", "sketch", "c"]).sort_values(["tree", "key", "sketch", "c"])
        rows = {c: pdf[c].to_numpy(np.int64) for c in ("tree", "key", "n", "c")}
        rows["sketch"] = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, SKETCH)
        import pandas as pd

        return pd.DataFrame(_pairs(rows, lags, 0, share))

    edges = found.filter("a is null and edge >= 0").groupBy("edge").applyInPandas(across, "a long, b long")
    return found.filter("a is not null").select("a", "b").unionByName(edges)


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, trees: int = 20, depth: int = 4, lags: int = 16, block: int = 1024, most: int = 1 << 22) -> DataFrame:
    """One row per row of docs (doc_id, text): its component of near-duplicates.

    A document's set holds its distinct shingles of `words` words (runs of bytes other than ASCII white space,
    A-Z lower-cased); with fewer words the whole sequence is one; without words (null, empty, blank) it is empty, and the
    document is linked with nothing. Documents are linked if 100 * intersection >= percent * union, always confirmed on
    full sets. Equal rows have equal results; rows that share an id but differ in text are judged apart; null ids are
    judged as any other but give no component_id (null if there is no other). An empty table gives no rows, other columns
    are ignored.

    Returns doc_id, n_shingles, component_id (least doc_id that links reach), kept (doc_id = component_id; without any id
    in the component: true), and rk, a key of id and text.

    trees, depth: a pair at the threshold escapes all trees with probability (1 - 0.8**depth)**trees, 3e-5 at the
    defaults; below MAYBE equal bytes of SKETCH a pair is ruled out, which happens to one at the threshold with
    probability 5e-6. lags: what shares a key with more than lags + 1 rows is found by rare shingles. block, most: where a group has
    more classes or shingles than this, blocks of it, each with its first class, are compared in full, and then what that
    leaves open with the whole group. Intermediate tables lie in the shared folder and are deleted as soon as they are read.
    """
    share = percent / 100
    docs = shared.keyed_documents(docs)
    if trees * depth < SKETCH:
        raise ValueError(f"trees * depth has to be {SKETCH} at least")
    tables = shared.Tables(docs.sparkSession, "near_dedup")
    signed = tables.save(_documents(docs, words, trees, depth))
    classes = signed.groupBy("hi", "lo").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    classes = tables.save(classes.withColumn("c", F.monotonically_increasing_id()))
    rows = tables.save(signed.drop("sig"))
    tables.drop(signed)
    group = _grouped(docs, classes, words, percent, trees, depth, lags, tables)
    shared.sweep(docs.sparkSession)
    group = group.join(classes.select(F.col("c").alias("node"), "n"), "node")
    sizes = group.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / most)).alias("blocks")).filter("size > 1")
    member = tables.save(group.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    ids = classes.select("hi", "lo", "c").join(member.withColumnRenamed("node", "c").drop("n"), "c")
    sets = tables.save(_full(docs, ids, words, docs.sparkSession).join(ids, ["hi", "lo"]).select("label", "block", "blocks", "c", "items"))
    first = sets.filter((F.col("c") == F.col("label")) & (F.col("blocks") > 1)).select("label", "c", "items", F.col("block").alias("home"))
    leaders = first.join(member.select("label", "block").distinct(), "label").filter("block <> home").select("label", "block", "c", "items")

    def confirm(pdf):
        pdf = pdf.sort_values("c")
        link = _linked if len(pdf) < 64 else shared.relieved(_linked)
        return link(pdf["c"], pdf["items"], pdf["c"], pdf["items"], percent)

    links = sets.select("label", "block", "c", "items").unionByName(leaders).groupBy("label", "block").applyInPandas(confirm, "u long, v long")
    links = tables.save(links)
    label = components.components(links, tables)
    more = _open(label, member.filter("blocks > 1").select("label", F.col("node").alias("c"), "n"), sets, percent, block, most, tables)
    if not more.isEmpty():
        label = components.components(links.unionByName(more), tables)
    best = label.join(classes.select(F.col("c").alias("node"), "least"), "node")
    best = label.join(best.groupBy("label").agg(F.min("least").alias("component")), "label").select(F.col("node").alias("c"), "component")
    judged = classes.join(best, "c", "left").select("hi", "lo", F.coalesce("component", "least").alias("component"))
    out = rows.select("doc_id", "rk", "n", "hi", "lo").join(judged, ["hi", "lo"])
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "rk")
    out = tables.save(out)
    tables.close(out)
    return out


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps; of equal id and text, one row."""
    key, of_id, of_key = shared.fresh(docs, "_key", "_of_id", "_of_key")
    kept = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias(of_id), F.col("rk").alias(of_key))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(kept[of_id]) & (keyed[key] == kept[of_key])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)


def _linked(labels, sets, of, its, percent: int):
    """Links (u, v) that join the components (labels) of sets and those (of) of its, all compared with each other."""
    import pandas as pd

    root = {x: x for x in {*labels.tolist(), *of.tolist()}}
    left = len(root)
    out: dict[str, list[int]] = {"u": [], "v": []}
    have = [np.frombuffer(x, U) for x in sets]
    size = np.array([len(x) for x in have])
    flat, owner = np.concatenate(have), np.repeat(np.arange(len(have)), size)
    by = np.argsort(flat, kind="stable")
    flat, owner, labels = flat[by], owner[by], labels.to_numpy()
    for mine, raw in zip(of.tolist(), its, strict=True):
        if left == 1:
            break
        x = np.frombuffer(raw, U)
        first = np.searchsorted(flat, x, "left")
        n = np.searchsorted(flat, x, "right") - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(have))
        for other in np.unique(labels[100 * both >= percent * (len(x) + size - both)]).tolist():
            a, b = components.find(root, mine), components.find(root, other)
            if a != b:
                root[max(a, b)] = min(a, b)
                left -= 1
                out["u"].append(mine)
                out["v"].append(other)
    return pd.DataFrame(out).astype("int64")


def _grouped(docs: DataFrame, classes: DataFrame, words: int, percent: int, trees: int, depth: int, lags: int, tables: shared.Tables) -> DataFrame:
    """(node, label): groups of classes that candidates join.

    The first trees join most of a large group; for the others it is one node, so that it is no longer a
    multitude of links.
    """
    few, share = range(min(4, trees)), percent / 100
    first = components.components(candidates(_rows(classes, few, trees, depth), lags, share, tables).toDF("u", "v"), tables)
    joined = tables.save(classes.join(first.withColumnRenamed("node", "c"), "c", "left").select("hi", "lo", "c", F.coalesce("label", "c").alias("g"), "n", "sig"))
    nodes = joined.select(F.col("g").alias("c"), "n", "sig")
    pairs = candidates(_rows(nodes, range(len(few), trees), trees, depth), lags, share, tables)
    second = components.components(pairs.toDF("u", "v"), tables).withColumnRenamed("node", "g")
    joined = tables.save(joined.join(second, "g", "left").select("hi", "lo", "c", F.coalesce("label", "g").alias("g"), "n", "sig"))
    some = tables.save(crowded(joined, trees, depth, lags))
    label = joined.select(F.col("c").alias("node"), F.col("g").alias("label"), "sig")
    if not some.isEmpty():
        some = joined.select("hi", "lo", "c").join(some, "c")
        third = components.components(by_rare_shingles(docs, some, words, percent, tables).toDF("u", "v"), tables).toDF("label", "least")
        label = label.join(third, "label", "left").select("node", F.coalesce("least", "label").alias("label"), "sig")
    return tables.save(label.filter("sig is not null").select("node", "label"))


def _open(label: DataFrame, large: DataFrame, sets: DataFrame, percent: int, block: int, most: int, tables: shared.Tables) -> DataFrame:
    """Links (u, v) that blocks have left out in large groups (label, c, n); label: of the components so far.

    All classes of a group that are not in its largest component are compared with all of the group on full sets, blocks
    of the former with blocks of the latter; what is in one component needs no more. So the work grows with the open
    classes times the group, which is the price of leaving out no pair.
    """
    rows = large.withColumnRenamed("label", "region").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    sizes = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).groupBy("region").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "label", "n")).alias("main"))

    def blocks(rows, n):
        return F.greatest(F.ceil(rows / block), F.ceil(n / most))

    sizes = sizes.select("region", F.col("main.label").alias("main"), blocks(F.col("rows"), F.col("n")).alias("lists"), blocks(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n")).alias("asks")).filter("asks > 0")
    rows = tables.save(rows.join(sizes, "region").join(sets.select("c", "items"), "c"))
    listed, asked = _dealt(rows, "region", F.col("label") != F.col("main"), F.xxhash64("c"))

    def compare(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        return shared.relieved(_linked)(left["label"], left["items"], right["of"], right["its"], percent)

    key = ("region", "list", "ask")
    asked = asked.select(*[F.col(k).alias(f"of_{k}") for k in key], F.col("label").alias("of"), F.col("items").alias("its"))
    both = listed.select(*key, "label", "items").groupBy(*key).cogroup(asked.groupBy(*[f"of_{k}" for k in key]))
    return tables.save(both.applyInPandas(compare, "u long, v long"))
