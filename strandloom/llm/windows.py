"""Windows of L symbols that start more than once in a corpus, found through content-defined anchors.

A window's anchor is its leftmost smallest k-symbol shingle (a minimiser). Equal windows have equal
anchors at equal places, and two windows of one segment - a maximal run of windows that share one
anchor place - are never equal. So every repeat joins two segments with equal anchor hashes:

1. Partition sketches of the anchors are merged into a count-min sketch of fixed size, which
   overestimates how often an anchor, and with it each of its windows, occurs.
2. Only segments with an estimate of two or more are written and grouped exactly by content. A segment
   whose whole content occurs twice is repeated as a whole.
3. Where an anchor has several different segments, their windows are compared, by the caller's choice
   of method, and each distinct segment gets the offsets of its repeated windows.

The sketch only saves work: a larger corpus makes it let through more segments, and loses none.
Cost is in proportion to the input; no step needs a group of segments in one task, except the chosen
method of 3, which says how it bounds its groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BITS = 24
_LOW = U((1 << _BITS) - 1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, by doubling."""
    n, span = len(a) - w + 1, 1
    while span * 2 <= w:
        a = np.minimum(a[: len(a) - span], a[span:])
        span *= 2
    return np.minimum(a[:n], a[w - span : w - span + n]) if span < w else a[:n]


@dataclass
class Segments:
    """start, n_windows: by symbol of the batch; anchor, content: hashes; prefix: of the polynomial hash."""

    start: np.ndarray
    n_windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    prefix: np.ndarray

    def window_hashes(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of the chosen segments, and how many each has."""
        n = self.n_windows[which]
        at = np.repeat(self.start[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        _, down = powers(len(self.prefix))
        return mix((self.prefix[at + length] - self.prefix[at]) * down[at] + U(length)), n


def segments(symbols: np.ndarray, ends: np.ndarray, length: int, k: int) -> Segments:
    """Segments of the windows of `length` symbols that lie within one piece; ends: where the pieces end."""
    n = len(symbols)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(symbols * up[:n], out=prefix[1:])
    none = np.zeros(0, np.int64)
    if n < length:
        return Segments(none, none, none.astype(U), none.astype(U), prefix)
    shingle = mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])
    packed = (shingle & ~_LOW) | np.arange(len(shingle), dtype=U)
    place = (sliding_min(packed, length - k + 1) & _LOW).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    room = np.repeat(ends, ends - starts)[: n - length + 1]
    ok = np.flatnonzero(np.arange(n - length + 1) + length <= room)
    if not len(ok):
        return Segments(none, none, none.astype(U), none.astype(U), prefix)
    at = place[ok]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    start, count = ok[first], np.diff(np.append(first, len(ok)))
    content = mix((prefix[start + count + (length - 1)] - prefix[start]) * down[start] + count.astype(U))
    return Segments(start, count, shingle[at[first]], content, prefix)


def pieces(batches: Iterator[tuple[int, np.ndarray]], length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of several documents together: (symbols, ends, document of each piece, its offset there).

    A document of more than `most` symbols is cut into pieces that overlap by length - 1, so that each
    window lies in exactly one.
    """
    hold: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def out():
        s = np.concatenate([x[0] for x in hold])
        return s, np.cumsum([len(x[0]) for x in hold]), np.array([x[1] for x in hold]), np.array([x[2] for x in hold])

    for doc, symbols in batches:
        for o in range(0, max(1, len(symbols) - length + 1), most):
            part = symbols[o : o + most + length - 1]
            if len(part) < length:
                continue
            hold.append((part, doc, o))
            size += len(part)
            if size >= most:
                yield out()
                hold, size = [], 0
    if hold:
        yield out()


# --- the sketch ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sketch:
    """bits: rows x 2**width cells, one bit each: whether the cell's count reached the threshold."""

    bits: tuple[bytes, ...]
    width: int

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimate of each key, the least of its cells, reaches the threshold."""
        ok = np.ones(len(keys), bool)
        for row, bits in enumerate(self.bits):
            c = cells(keys, row, self.width)
            ok &= (np.frombuffer(bits, np.uint8)[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return ok


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys ^ U(0xA5A5A5A5A5A5A5A5 * (row + 1) & (2**64 - 1))) >> U(64 - width)).astype(np.int64)


SLICES = 16  # of a row's cells; each is merged by itself


def merged_sketch(keys: DataFrame, read: Callable[[Iterator[dict]], Iterator[np.ndarray]], threshold: int, width: int, rows: int) -> Sketch:
    """Merges the partitions' sketches of the keys that read() yields from a partition's batches.

    A partition sends the cells it touched with counts up to the threshold; a slice of cells is merged in
    an array of fixed size, whatever the number of partitions. The driver gets rows * 2**width bits.
    """
    per = (1 << width) // SLICES

    def partial(batches):
        def flush(hold):
            k = np.concatenate(hold)
            for row in range(rows):
                c, n = np.unique(cells(k, row, width), return_counts=True)
                cut = np.searchsorted(c, np.arange(SLICES + 1) * per)
                n = np.minimum(n, threshold).astype(np.uint8)
                got = [(row * SLICES + s, (c[a:b] - s * per).astype(np.uint32).tobytes(), n[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield {"slice": [x[0] for x in got], "cells": [x[1] for x in got], "counts": [x[2] for x in got]}

        hold, size = [], 0
        for k in read(batches):
            hold.append(k)
            size += len(k)
            if size >= 1 << 21:
                yield from flush(hold)
                hold, size = [], 0
        if size:
            yield from flush(hold)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c, n in zip(b["slice"].to_pylist(), shared.as_bytes(b["cells"]), shared.as_bytes(b["counts"]), strict=True):
                a = sums.setdefault(s, np.zeros(per, np.uint8))
                c = np.frombuffer(c, np.uint32)
                a[c] = np.minimum(a[c] + np.frombuffer(n, np.uint8), threshold)
        for s, a in sums.items():
            yield {"slice": [s], "bits": [np.packbits(a >= threshold).tobytes()]}

    parts = shared.stream(keys, partial, "slice int, cells binary, counts binary").repartition(SLICES * rows, "slice")
    out = [bytearray((1 << width) // 8) for _ in range(rows)]
    for r in shared.stream(parts, merge, "slice int, bits binary").collect():  # rows * 2**width bits, in one job
        at = r["slice"] % SLICES * per // 8
        out[r["slice"] // SLICES][at : at + per // 8] = r["bits"]
    return Sketch(tuple(bytes(x) for x in out), width)


# --- the whole search ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """symbols: (batches of doc_id, text, rk) -> per batch its columns and an iterator of (row, symbols).

    length: of a window; k: of an anchor's shingle; most: symbols worked on at once.
    """

    symbols: Callable
    length: int
    k: int
    most: int = 1 << 17
    width: int = 26
    rows: int = 2


def _each(plan: Plan, batches: Iterator[dict]):
    for b, docs in plan.symbols(batches):
        for s, ends, doc, offset in pieces(docs, plan.length, plan.most):
            g = segments(s, ends, plan.length, plan.k)
            which = np.searchsorted(ends, g.start, side="right")
            yield b, g, doc[which], offset[which] + g.start - np.concatenate([[0], ends[:-1]])[which]


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def repeated(docs: DataFrame, plan: Plan, resolve: Callable[[DataFrame, DataFrame], DataFrame], detail: Callable, detail_schema: str) -> DataFrame:
    """Of keyed documents, those with repeated windows: doc_id, rk, found: array of (pos, n_windows, offs).

    offs: offsets of the repeated windows from pos; null: all n_windows. detail(batch, segments, chosen,
    documents, positions) yields what resolve() needs of each segment that shares its anchor with a
    different one; resolve(details, distinct segments) returns (anchor, content, offs).
    """
    spark = docs.sparkSession

    def anchors(batches):
        for _, g, _, _ in _each(plan, batches):
            yield g.anchor

    sketch = spark.sparkContext.broadcast(merged_sketch(docs, anchors, 2, plan.width, plan.rows))

    def occurrences(batches):
        for b, g, doc, pos in _each(plan, batches):
            ok = np.flatnonzero(sketch.value.passes(g.anchor))
            doc = doc[ok]
            yield {"anchor": _long(g.anchor[ok]), "content": _long(g.content[ok]), "doc_id": b["doc_id"].take(doc), "rk": b["rk"].take(doc), "pos": pos[ok].astype(np.int32), "n_windows": g.n_windows[ok].astype(np.int16)}

    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    found = shared.saved(shared.stream(docs, occurrences, f"anchor long, content long, doc_id {kind}, rk long, pos int, n_windows short"))
    distinct = shared.saved(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.max("n_windows").alias("n_windows")))
    several = shared.saved(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))

    def numbers(batches):
        for b in batches:
            yield np.asarray(b["anchor"]).view(U)

    shared.sweep(spark)
    shared_anchor = spark.sparkContext.broadcast(merged_sketch(several.select("anchor"), numbers, 1, plan.width, plan.rows))

    def details(batches):
        for b, g, doc, pos in _each(plan, batches):
            ok = np.flatnonzero(shared_anchor.value.passes(g.anchor))
            yield from detail(b, g, ok, doc[ok], pos[ok])

    mixed = distinct.join(several, "anchor")
    parts = shared.stream(docs, details, detail_schema)
    names = [c for c in parts.columns if c not in ("anchor", "content")]
    parts = parts.groupBy("anchor", "content").agg(*[F.first(c).alias(c) for c in names])
    parts = parts.join(mixed, ["anchor", "content"])
    verdicts = resolve(parts, mixed)
    whole = distinct.filter("n > 1").select("anchor", "content", F.lit(None).cast("array<int>").alias("offs"))
    return (
        found.join(whole.unionByName(verdicts), ["anchor", "content"])
        .groupBy("doc_id", "rk")
        .agg(F.collect_list(F.struct("pos", "n_windows", "offs")).alias("found"))
    )


def by_window_hash(each: DataFrame) -> DataFrame:
    """Windows (anchor, content, n, off, h: hash) -> offsets of repeats, for segments that occur once.

    An exact group-by on (anchor, window hash), 128 bits together. Counts are summed before the shuffle, so
    that a frequent window is no hot key.
    """
    twice = each.groupBy("anchor", "h").agg(F.sum("n").alias("times")).filter("times > 1").select("anchor", "h")
    return each.filter("n = 1").join(twice, ["anchor", "h"], "left_semi").groupBy("anchor", "content").agg(F.sort_array(F.collect_set("off")).alias("offs"))


def covered(n: int, length: int, found: list[dict] | None) -> np.ndarray:
    """Which of n symbols lie in a repeated window."""
    edge = np.zeros(n + 1, np.int32)
    for f in found or ():
        if f["offs"] is None:
            edge[f["pos"]] += 1
            edge[f["pos"] + f["n_windows"] - 1 + length] -= 1
        else:
            at = f["pos"] + np.asarray(f["offs"], np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0
