"""Language-model scoring by partial matching: a byte-context trie with escapes and symbol exclusion.

The trie holds, for contexts of 0 to `order` bytes, how often each byte followed them in the training texts. A
byte is coded in its longest known context; a byte unseen there costs an escape (method C: one count per
distinct byte) to the context that is a byte shorter, where the bytes already ruled out are excluded. Behind order 0
all 256 bytes are alike. A text starts behind padding and ends with a terminator; both are 0xFF, which no UTF-8
text holds. The code length of a document is minus the sum of the logarithms.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

U = np.uint64
PIECE = 1 << 19


def pieces(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, first code of each part, document of each part): a code is a context and the byte behind it.

    Parts of about PIECE bytes together; a longer document is in several parts.
    """
    hold: list[bytes] = []
    docs: list[int] = []
    size = 0

    def out():
        raw = np.frombuffer(b"".join(hold), np.uint8)
        z = np.zeros(len(raw) - order, U)
        for j in range(order + 1):
            z = (z << U(8)) | raw[j : j + len(z)]
        sizes = np.array([len(x) for x in hold])
        own = np.ones(len(raw), bool)  # the last `order` places of a part start in it and end behind it
        ends = np.cumsum(sizes)
        for j in range(1, order + 1):
            own[ends - j] = False
        return z[own[: len(z)]], np.concatenate([[0], np.cumsum(sizes - order)[:-1]]), np.array(docs)

    for d, text in enumerate(texts):
        whole = b"\xff" * order + text + b"\xff"
        for at in range(0, len(whole) - order, PIECE):
            hold.append(whole[at : at + PIECE + order])
            docs.append(d)
            size += len(hold[-1])
            if size >= PIECE:
                yield out()
                hold, docs, size = [], [], 0
    if hold:
        yield out()


def _spots(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, x), max(len(sorted_) - 1, 0))
    return at, (sorted_[at] == x) if len(sorted_) else np.zeros(len(x), bool)


@dataclass(frozen=True)
class Level:
    """Of contexts of one length: codes and counts of (context, byte); per context the sum, the number of distinct bytes,
    and how much of its shorter context (counts, distinct bytes) these bytes take up there."""

    codes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    shorter_total: np.ndarray
    shorter_kinds: np.ndarray


class Trie:
    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: for k = 0, 1, ...: sorted codes of k context bytes and a symbol, and their counts."""
        self.levels: list[Level] = []
        for k, (codes, counts) in enumerate(levels):
            contexts, of = np.unique(codes >> U(8), return_inverse=True)
            n = len(contexts)
            lower_t, lower_k = np.zeros(n), np.zeros(n)
            if k:
                at, hit = _spots(self.levels[-1].codes, codes & U((1 << 8 * k) - 1))
                lower_t = np.bincount(of[hit], self.levels[-1].counts[at[hit]], n)
                lower_k = np.bincount(of[hit], minlength=n)
            self.levels.append(Level(codes, counts.astype(np.int64), contexts, np.bincount(of, counts, n), np.bincount(of, minlength=n), lower_t, lower_k))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Of each code (context of the greatest length and symbol), the logarithm of its probability."""
        out = np.zeros(len(codes))
        live = np.arange(len(codes))
        less, fewer = np.zeros(len(codes)), np.zeros(len(codes))  # what exclusion takes from the sum and the kinds
        for k in range(len(self.levels) - 1, -1, -1):
            v = self.levels[k]
            code = codes[live] & U((1 << 8 * (k + 1)) - 1)
            at, known = _spots(v.contexts, code >> U(8))
            total = np.where(known, v.total[at] if len(v.total) else 0, 0) - less[live]
            kinds = np.where(known, v.kinds[at] if len(v.kinds) else 0, 0) - fewer[live]
            whole = total + kinds
            spot, hit = _spots(v.codes, code)
            out[live[hit]] += np.log10(v.counts[spot[hit]] / whole[hit])
            rest = ~hit
            escape = rest & (whole > 0) & (kinds > 0)
            out[live[escape]] += np.log10(kinds[escape] / whole[escape])
            new = live[rest & known]
            less[new], fewer[new] = v.shorter_total[at[rest & known]], v.shorter_kinds[at[rest & known]]
            unknown = live[rest & ~known]
            less[unknown] = fewer[unknown] = 0
            live = live[rest]
        seen = len(self.levels[0].codes)
        out[live] -= math.log10(max(1, 256 - seen))
        return out


def _within(counts: DataFrame, most: int) -> DataFrame:
    """Rows with the largest n, at most `most` of them, by a threshold on n; the driver gets at most 256 sums."""
    level = F.floor(F.log2("n") * 4)
    least, total = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def count(docs: DataFrame, order: int) -> DataFrame:
    """(code, n, times): how often each code occurs in the training texts and in all texts (text, held_out)."""

    def counted(batches):
        hold: dict[str, list[np.ndarray]] = {"code": [], "n": [], "times": []}

        def flush():
            if hold["code"]:
                at, codes = pd.factorize(np.concatenate(hold["code"]))
                for c in ("n", "times"):
                    hold[c] = [np.bincount(at, np.concatenate(hold[c])).astype(np.int64)]
                hold["code"] = [codes]

        def out():
            flush()
            if hold["code"]:
                codes = hold["code"][0].view(np.int64)
                for i in range(0, len(codes), 1 << 18):
                    yield {"code": codes[i : i + (1 << 18)]} | {c: hold[c][0][i : i + (1 << 18)] for c in ("n", "times")}
            hold.update(code=[], n=[], times=[])

        held = 0
        for b in batches:
            own = ~np.array(b["held_out"].to_pylist(), bool)
            for codes, first, doc in pieces([(t or b"").lower() for t in shared.as_bytes(b["text"])], order):
                training = np.repeat(own[doc], np.diff(np.append(first, len(codes))))
                at, codes = pd.factorize(codes)
                hold["code"].append(codes)
                hold["n"].append(np.bincount(at, training))
                hold["times"].append(np.bincount(at))
                held += len(codes)
                if held > 1 << 21:
                    flush()
                    held = len(hold["code"][0])
                    if held > 1 << 20:
                        yield from out()
                        held = 0
        yield from out()

    return shared.saved(shared.stream(docs.select("text", "held_out"), counted, "code long, n long, times long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("times").alias("times")))


def _shorter(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of k context bytes from those of longer contexts."""
    short, of = np.unique(codes & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return short, np.bincount(of, counts, len(short)).astype(np.int64)


def coded(counts: DataFrame, order: int) -> DataFrame:
    """(code, times, cost): the logarithm of the probability of each code of count(), from all training counts.

    Levels of up to two context bytes have at most 2**24 codes and go to every task. Those of more share the last three context
    bytes with the codes that ask for them, and are built where all codes of such an ending lie together.
    """
    low = min(order, 2)
    seen = counts.filter("n > 0").groupBy(F.col("code").bitwiseAND((1 << 8 * (low + 1)) - 1).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    codes, n = seen["code"].to_numpy().view(U), seen["n"].to_numpy()
    lowest = counts.sparkSession.sparkContext.broadcast([_shorter(codes, n, k) for k in range(low + 1)])
    ending = F.shiftrightunsigned("code", 8).bitwiseAND((1 << 24) - 1)
    rows = counts.withColumn("ending", ending).repartition("ending").sortWithinPartitions("ending")

    def run(batches):
        hold: list[np.ndarray] = []  # code, n, times, ending
        held = 0

        def out(part):
            codes, n = part[0].view(U), part[1]
            full, counts = codes[n > 0], n[n > 0]
            trie = Trie(lowest.value + [_shorter(full, counts, k) for k in range(low + 1, order + 1)])
            return {"code": part[0], "times": part[2], "cost": trie.log10(codes)}

        for b in batches:
            hold.append(np.array([np.asarray(b[c]) for c in ("code", "n", "times", "ending")], np.int64))
            held += hold[-1].shape[1]
            if held >= 1 << 19:
                part = np.concatenate(hold, 1)
                end = int(np.searchsorted(part[3], part[3][-1]))  # the last ending may go on
                if end:
                    yield out(part[:, :end])
                hold = [part[:, end:]]
                held = part.shape[1] - end
        if held:
            yield out(np.concatenate(hold, 1))

    return shared.saved(shared.stream(rows, run, "code long, times long, cost double"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 7, is 2; null ids are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, order: int = 5, most_nodes: int = 1 << 21, most_frequent: int = 1 << 18) -> DataFrame:
    """Scores the whole text of every row of docs (doc_id, text) by a model of the rows that are not held out.

    Texts are lower-cased (A-Z); null texts count as empty. Tokens are runs of bytes other than ASCII white space, and
    one end per document. Equal rows count and are scored each by itself; null ids are training rows. Without training
    rows N and V are 0 and every byte costs 1/256; an empty table gives no rows; other columns are ignored.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens (N), base_score (sum over tokens of
    log10((c+1)/(N+V+1))), score (log10 of the text's probability), bits (the code length).

    most_nodes, most_frequent: codes with their costs and word counts sent to the executors; other codes and words are
    joined with theirs, so that neither bound changes a result.
    """
    spark = docs.sparkSession
    docs = shared.keyed_documents(docs).withColumn("held_out", held_out(F.col("doc_id")))
    training = docs.filter("not held_out").select("text")
    costs = coded(count(docs, order), order)
    often = _within(costs.withColumnRenamed("times", "n"), most_nodes).toArrow()
    by = np.argsort(often["code"].to_numpy())
    model = spark.sparkContext.broadcast((often["code"].to_numpy()[by], often["cost"].to_numpy()[by]))

    def counted(batches):
        c: Counter[bytes] = Counter()

        def out():
            got = list(c.items())
            c.clear()
            for i in range(0, len(got), 1 << 16):
                yield {"word": [w for w, _ in got[i : i + (1 << 16)]], "n": [n for _, n in got[i : i + (1 << 16)]]}

        for b in batches:
            for t in shared.as_bytes(b["text"]):
                c.update(t.lower().split())
                if len(c) > 1 << 20:
                    yield from out()
        yield from out()

    words = shared.saved(shared.stream(training, counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    sums = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = training.count()
    total, kinds = sums["n"] + ends, sums["v"] + (ends > 0)
    top = _within(words, most_frequent).toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(top["word"].to_pylist(), np.log10(top["n"].to_numpy() + 1.0).tolist(), strict=True)))
    end, per_token = math.log10(ends + 1), math.log10(total + kinds + 1)

    def scored(batches):
        known, (code_keys, code_costs) = frequent.value, model.value
        for b in batches:
            for at in range(0, len(b["text"]), 512):
                texts = [t.lower() for t in shared.as_bytes(b["text"].slice(at, 512))]
                out = {c: b[c].slice(at, 512) for c in ("doc_id", "rk", "held_out")} | {c: [] for c in ("n_tokens", "n_known", "base", "rare", "times")}
                for t in texts:
                    w = t.split()
                    got = list(map(known.get, w))
                    rare = Counter(x for x, g in zip(w, got, strict=True) if g is None) if None in got else {}
                    n = sum(rare.values())
                    out["n_tokens"].append(len(w) + 1)
                    out["n_known"].append(len(w) - n + (ends > 0))
                    out["base"].append(math.fsum(filter(None, got)) + end)
                    out["rare"].append(list(rare.keys()))
                    out["times"].append(list(rare.values()))
                sums = np.zeros(len(texts))
                far: list[list[int]] = [[] for _ in texts]
                for codes, first, doc in pieces(texts, order):
                    place, distinct = pd.factorize(codes.view(np.int64))
                    at, hit = _spots(code_keys, distinct)
                    cost = np.where(hit, code_costs[at], 0.0) if len(code_costs) else np.zeros(len(at))
                    np.add.at(sums, doc, np.add.reduceat(cost[place], first))
                    miss = np.flatnonzero(~hit[place])
                    for d, code in zip(doc[np.searchsorted(first, miss, "right") - 1].tolist(), codes[miss].tolist(), strict=True):
                        far[d].append(code)
                yield out | {"score": sums, "far": far}

    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    rows = shared.saved(shared.stream(docs, scored, f"doc_id {kind}, rk long, held_out boolean, n_tokens long, n_known long, base double, rare array<binary>, times array<long>, score double, far array<long>"))
    # One row marked -1 for each document stands for its copies, so that equal rows don't count twice.
    rare = rows.select("doc_id", "rk", F.explode(F.concat(F.arrays_zip("rare", "times"), F.array(F.struct(F.lit(None).cast("binary").alias("rare"), F.lit(-1).cast("long").alias("times"))))).alias("x"))
    rare = rare.select("doc_id", "rk", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.filter("word is not null").join(words, "word", "left").select("doc_id", "rk", "times", "n").unionByName(rare.filter("word is null").select("doc_id", "rk", "times", F.lit(None).cast("long").alias("n")))
    rare = rare.groupBy("doc_id", "rk").agg(
        F.count(F.when(F.col("times") < 0, 1)).alias("copies"),
        F.sum(F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).otherwise(0.0)).alias("more"),
        F.sum(F.when((F.col("times") > 0) & F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    # Equal rows have equal codes: what all copies find together is divided by their number, as for words.
    far = rows.select("doc_id", "rk", F.explode("far").alias("code")).join(costs.select("code", "cost"), "code")
    far = far.groupBy("doc_id", "rk").agg(F.sum("cost").alias("more_score")).withColumnsRenamed({"doc_id": "_far_id", "rk": "_far_rk"})
    out = rows.drop("rare", "times", "far").join(rare.withColumnsRenamed({"doc_id": "_id", "rk": "_rk"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk")))
    out = out.join(far, F.col("doc_id").eqNullSafe(F.col("_far_id")) & (F.col("rk") == F.col("_far_rk")), "left")
    score = F.col("score") + F.coalesce(F.col("more_score") / F.col("copies"), F.lit(0.0))
    base = F.col("base") + F.col("more") / F.col("copies") - F.col("n_tokens") * F.lit(per_token)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (F.col("more_known") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        (-score / math.log10(2)).alias("bits"),
    )
