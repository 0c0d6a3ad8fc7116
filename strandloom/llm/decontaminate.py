"""Benchmark decontamination: test items found inside documents by containment of word shingles.

Items are partitioned by the size m of their shingle set. A containment of at least c means that at most
m - ceil(c m) shingles of an item are missing, so of its m - ceil(c m) + 1 least MinHash values (its sketch,
whose length thus follows from its size class) at least one is in the document. Documents are looked up in the
sketches alone; whom they hit are candidates, which lose no pair, and only these are verified on all of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, windows
from .substring_dedup import WordHashes

U = np.uint64


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles of hashed words; with fewer words the whole sequence is one; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, U)
    for i in range(n):
        h = windows.mix(h ^ words[i : len(words) - n + 1 + i]) + U(n)
    return h


def item_slices(items: DataFrame, n: int, containment: float, most_shingles: int) -> Iterator[tuple]:
    """(sketch keys, their owners, sets, ids, lengths) of items, in slices of about most_shingles: what one pass looks for.

    lengths: of shingles in words, n and those of shorter items.
    """
    known, keys, owners, sets, ids, lengths, held = WordHashes(), [], [], [], [], {n}, 0
    for r in items.select("item_id", "text").toLocalIterator():
        words = known.of((r["text"] or "").encode().lower().split())
        s = np.unique(shingle_hashes(words, n))
        if not len(s):
            continue
        need = max(1, math.ceil(containment * len(s) - 1e-9))
        keys.append(s[: len(s) - need + 1])  # np.unique has sorted by hash
        owners.append(np.full(len(keys[-1]), len(ids)))
        sets.append(s)
        ids.append(r["item_id"])
        lengths.add(min(n, len(words)))
        held += len(s)
        if held >= most_shingles:
            yield lookup(keys, owners, sets, ids, lengths)
            keys, owners, sets, ids, lengths, held = [], [], [], [], {n}, 0
    if ids:
        yield lookup(keys, owners, sets, ids, lengths)


def lookup(keys: list, owners: list, sets: list, ids: list, lengths: set[int]) -> tuple:
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    return flat[order], np.concatenate(owners)[order], sets, ids, sorted(lengths)


def finder(wanted: tuple, n: int, containment: float):
    """text -> (number of the item, shingles found) for the items contained in it."""
    keys, owners, sets, _, lengths = wanted
    low, top = 20, U(44)
    filled = np.zeros(1 << low, bool)
    filled[(keys >> top).astype(np.int64)] = True
    known = WordHashes()

    def find(text: bytes | None) -> list[tuple[int, int]]:
        nonlocal known
        if not text:
            return []
        if len(known) > 1 << 19:
            known = WordHashes()
        words = known.of(text.lower().split())
        every = np.concatenate([shingle_hashes(words, m) for m in lengths])
        h = np.unique(every[filled[(every >> top).astype(np.int64)]])
        first, last = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        at = [np.arange(a, z) for a, z in zip(first.tolist(), last.tolist(), strict=True) if a < z]
        if not at:
            return []
        every, out = np.sort(every), []
        for i in np.unique(owners[np.concatenate(at)]).tolist():  # candidates
            s = sets[i]
            hits = int((np.searchsorted(every, s, "right") > np.searchsorted(every, s, "left")).sum())
            if hits >= math.ceil(containment * len(s) - 1e-9):
                out.append((i, hits))
        return out

    return find


def contained(docs: DataFrame, items: DataFrame, n: int = 5, containment: float = 0.8, most_shingles: int = 1 << 20) -> DataFrame:
    """Pairs (doc_id, item_id) where at least `containment` of the item's distinct shingles are in the document.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; shingles have n words; an item
    of fewer words is one shingle, found wherever its words follow each other. Items and documents without words (null, empty, blank) match nothing. Equal rows of
    docs give equal pairs, each row its own; an item that occurs twice is reported for each row. Other columns are
    ignored; an empty table on either side gives no pairs.
    Returns doc_id, item_id, n_shingles (of the item), hits, containment.

    The items are the stated query set: they are searched in slices of about most_shingles shingles, and each slice, which
    bounds what is sent to the executors, is matched in one pass over the documents without a shuffle.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    of = dict(items.dtypes)["item_id"].replace("bigint", "long")
    schema = f"doc_id {kind}, item_id {of}, n_shingles long, hits long"
    out = spark.createDataFrame([], schema)
    for some in item_slices(items, n, containment, most_shingles):
        wanted = spark.sparkContext.broadcast(some)

        def search(batches, wanted=wanted):
            find = finder(wanted.value, n, containment)
            _, _, sets, ids, _ = wanted.value
            for b in batches:
                out = {"doc_id": [], "item_id": [], "n_shingles": [], "hits": []}
                for doc, text in zip(b["doc_id"].to_pylist(), shared.as_bytes(b["text"]), strict=True):
                    for i, hits in find(text):
                        for k, v in (("doc_id", doc), ("item_id", ids[i]), ("n_shingles", len(sets[i])), ("hits", hits)):
                            out[k].append(v)
                yield out

        out = out.unionByName(shared.stream(docs, search, schema))
    return out.withColumn("containment", F.col("hits") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, n: int = 5, containment: float = 0.8, most_shingles: int = 1 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item; as contained() finds them."""
    for found in item_slices(items, n, containment, most_shingles):
        wanted = docs.sparkSession.sparkContext.broadcast(found)
        docs = shared.rewrite(docs, _without(wanted, n, containment))
    return docs


def _without(wanted, n: int, containment: float):
    find = None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal find
        find = find or finder(wanted.value, n, containment)
        return batch.filter(pa.array([not find(t) for t in shared.as_bytes(batch["text"])], pa.bool_()))

    return run
