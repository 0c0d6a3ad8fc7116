"""Collocations by position bitmaps: phrases of two to five words that stand together more often than their parts explain.

The texts of a language are cut into shards. In a shard each frequent word has a bitmap of its positions, of which only
the bytes that are not zero are kept; an empty position stands between pieces, so nothing crosses them. A phrase's bitmap
is that of its first words, shifted by one, AND that of its last two words; its popcount is how often the shard holds
it. Phrases grow depth-first from one run of prefixes after the other, and popcounts are summed over the shards.

Shards first ask which of their words, then which of their pairs are frequent everywhere; only these grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from . import shared
from .byte_bpe import _chunks, _packed, _slices, _unpacked

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: 0: of a word; 1: between words; 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
#: Positions in one element of a bitmap.
BITS = 8
LONGEST = 5
#: Shard numbers in one list of the shards that hold a word; the upper bits are those of partitions.
BLOCK = 4096 << 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, and each word's position: one is left free between two pieces."""
    cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    first = cuts[:-1] - cuts[0]
    kind = KIND[data]
    parted = kind == 2
    begin = np.zeros(len(data), bool)
    begin[first[first < len(data)]] = True
    start = begin.copy()
    start[1:] |= kind[:-1] != 0
    keep = kind == 0
    start = np.flatnonzero(start & keep)
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    breaks = np.cumsum(parted | begin, dtype=np.int32)[start]
    at = np.append(np.cumsum(keep, dtype=np.int32)[start] - 1, keep.sum()).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(LOWER[data[keep]])])
    return words, np.arange(len(start)) + np.cumsum(np.diff(breaks, prepend=breaks[0]) > 0)


class Bitmaps:
    """Bitmaps of many items: a row per element that is not zero, sorted by block; the rows of block b are ends[b] to ends[b + 1]."""

    def __init__(self, block: np.ndarray, item: np.ndarray, bits: np.ndarray, blocks: int):
        order = np.argsort(block, kind="stable")
        self.block, self.item, self.bits = block[order], item[order], bits[order]
        self.ends = np.searchsorted(self.block, np.arange(blocks + 2))

    @staticmethod
    def of(items: np.ndarray) -> Bitmaps:
        """items: what stands at each position; -1: nothing."""
        at = np.flatnonzero(items >= 0)
        return Bitmaps((at // BITS).astype(np.int32), items[at], (1 << (at % BITS)).astype(np.uint8), len(items) // BITS + 1)

    def after(self, block: np.ndarray, bits: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows (block, bits), shifted by one, AND all rows of this: which row of the first, which of this, the bits that are left."""
        carry = np.flatnonzero(bits >> (BITS - 1))
        row = np.concatenate([np.arange(len(bits)), carry])
        block, bits = np.concatenate([block, block[carry] + 1]), np.concatenate([bits << np.uint8(1), np.ones(len(carry), np.uint8)])
        each = self.ends[block + 1] - self.ends[block]
        end, lo = np.cumsum(each), 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] - each[lo] + most, "right")))
            n = each[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            right = np.arange(len(left)) + np.repeat(self.ends[block[lo:hi]] - (np.cumsum(n) - n), n)
            both = bits[left] & self.bits[right]
            some = np.flatnonzero(both)
            yield row[left[some]], right[some], both[some]
            lo = hi


def _counted(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each row's among them, and the set bits of each."""
    kinds, which = np.unique(key, return_inverse=True)
    return kinds, which, np.bincount(which, np.bitwise_count(bits), len(kinds)).astype(np.int64)


def _pairs(items: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring items as left * n + right, and how often each pair stands."""
    one = Bitmaps.of(items)
    found = [_counted(one.item[a].astype(np.int64) * n + one.item[b], bits) for a, b, bits in one.after(one.block, one.bits)]
    keys, counts = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 2))
    kinds, which = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(which, counts, len(kinds)).astype(np.int64)


def _grown(items: np.ndarray, n: int, pairs: np.ndarray, longest: int = LONGEST, rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of three words to `longest` whose neighbours are all in pairs (sorted left * n + right): a matrix of items, a phrase a row, and their counts.

    rows: of the bitmaps of the prefixes that are extended at a time, to the end, before the next ones are.
    """
    one = Bitmaps.of(items)
    block, pair, bits = [], [], []
    for a, b, left in one.after(one.block, one.bits):
        key = one.item[a].astype(np.int64) * n + one.item[b]
        at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        ok = np.flatnonzero(pairs[at] == key) if len(pairs) else []
        block.append(one.block[b][ok])
        pair.append(at[ok])
        bits.append(left[ok])
    if not block:
        return
    two = Bitmaps(np.concatenate(block), np.concatenate(pair), np.concatenate(bits), len(one.ends) - 2)
    last = pairs % n
    order = np.argsort(two.item, kind="stable")
    ends = np.searchsorted(two.item[order], np.arange(len(pairs) + 1))

    def extend(phrases: np.ndarray, block: np.ndarray, own: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """phrases: a row of items each; (block, own, bits): their bitmaps, own being the phrase."""
        got = [(own[a] * len(pairs) + two.item[b], two.block[b], left) for a, b, left in two.after(block, bits)]
        key, block, bits = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.int64) for i in range(3))
        if not len(key):
            return
        kinds, own, counts = _counted(key, bits)
        longer = np.column_stack([phrases[kinds // len(pairs)], last[kinds % len(pairs)]])
        yield longer, counts
        if longer.shape[1] < longest:
            yield from extend(longer, block, own, bits)

    lo = 0
    while lo < len(pairs):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + rows, "right")) - 1)
        mine = order[ends[lo] : ends[hi]]
        yield from extend(np.column_stack([pairs[lo:hi] // n, last[lo:hi]]), two.block[mine], two.item[mine] - lo, two.bits[mine])
        lo = hi


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """One row per part of a partition and language: its words, how often each occurs, and their numbers by position (-1: none)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        part, n = TaskContext.get().partitionId(), 0
        for langs, texts in _chunks(({"doc_id": b["lang"], "text": b["text"]} for b in batches), shard_bytes):
            for lang in pc.unique(langs).to_pylist():
                parts, places, end = [], [], 0
                for some in _slices(texts.filter(pc.equal(langs, lang))):
                    words, at = words_of(some)
                    parts.append(words)
                    places.append(at + end)
                    end += int(at[-1]) + 2 if len(at) else 0
                at = np.concatenate(places)
                if not len(at):
                    continue
                names, code, counts = shared.coded(pa.concat_arrays(parts))
                items = np.full(end, -1, np.int32)
                items[at] = code
                yield {"shard": [part << 32 | n], "lang": [lang], "n_words": [len(at)], "items": [shared.packed_codes(items)], "words": pa.ListArray.from_arrays([0, len(names)], names), "counts": pa.ListArray.from_arrays([0, len(names)], pa.array(counts))}
                n += 1

    return shared.stream(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), run, "shard long, lang string, n_words long, items binary, words array<string>, counts array<long>")


def _by_shard(shards: DataFrame, answers: DataFrame, fn: Callable[[np.ndarray, pa.Table, int], pa.Table], buckets: int) -> DataFrame:
    """fn of each shard's positions and what was answered to it (of: the shard)."""
    session.ship(shards.sparkSession)
    schema = "bucket int, shard long, packed binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [fn(shared.unpacked_codes(x), right, buckets) for x in left["items"].to_pylist() if right.num_rows]
        return pa.concat_tables(out) if out else shared.schema_of(schema).empty_table()

    def relieved(left: pa.Table, right: pa.Table) -> pa.Table:
        return shared.relieved(run)(left, right)

    return shards.select("shard", "items").groupBy("shard").cogroup(answers.groupBy("of")).applyInArrow(relieved, schema)


def _numbered(items: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions by the frequent words of the shard (-1: none), in the order of their ids; these ids."""
    words = _unpacked(answers["packed"].drop_null())
    words = words.take(pc.sort_indices(words["id"]))
    number = np.full(max(int(items.max(initial=-1)), int(pc.max(words["code"]).as_py() or 0)) + 2, -1, np.int32)
    number[words["code"].to_numpy()] = np.arange(len(words))
    return number[items], words["id"].to_numpy()


def _answered(known: DataFrame) -> DataFrame:
    """Words with their id and where they are (shards, codes: lists) as (shard, packed): the codes and ids of a shard together."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids = np.repeat(b["id"].to_numpy(), np.diff(b["shards"].offsets.to_numpy()))
            shard, code = b["shards"].flatten().to_numpy(), b["codes"].flatten().to_numpy()
            order = np.argsort(shard, kind="stable")
            edge = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                at = order[lo:hi]
                yield {"shard": [int(shard[order[lo]])], "packed": [_packed(code=pa.array(code[at]), id=pa.array(ids[at]))]}

    return shared.stream(known, run, "shard long, packed binary").withColumnRenamed("shard", "of")


def _dealt(shard: int, ids: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Phrases (a row of ids each) and their counts by a hash of the phrase, a shard's share of a bucket together."""
    key = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    rows = [order[lo:hi] for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
    packed = [_packed(n=pa.array(counts[r]), **{f"w{i}": pa.array(ids[r, i].astype(np.uint32)) for i in range(ids.shape[1])}) for r in rows]
    return pa.table({"bucket": pa.array(bucket[order[edge[:-1]]], pa.int32()), "shard": pa.array([shard] * len(rows), pa.int64()), "packed": pa.array(packed, pa.binary())})


def _ids_of(t: pa.Table) -> np.ndarray:
    return np.column_stack([t[c].to_numpy() for c in t.column_names if c != "n"]).astype(np.int64)


def _summed(t: pa.Table, least: int) -> pa.Table:
    """Of a bucket: the phrases that all shards hold `least` times or more and their counts (shard: null), and for each shard those of its own."""
    shards, tables = t["shard"].to_pylist(), [_unpacked(pa.chunked_array([[x]])) for x in t["packed"].to_pylist()]
    out = []
    for width in sorted({x.num_columns for x in tables}):
        some = [(s, x) for s, x in zip(shards, tables, strict=True) if x.num_columns == width]
        ids = np.concatenate([_ids_of(x) for _, x in some])
        n = np.concatenate([x["n"].to_numpy() for _, x in some])
        order = np.lexsort(ids.T[::-1])
        first = np.flatnonzero(np.append(True, (ids[order][1:] != ids[order][:-1]).any(axis=1)))
        sums = np.add.reduceat(n[order], first)
        kept = sums >= least
        frequent = np.empty(len(ids), bool)
        frequent[order] = np.repeat(kept, np.diff(np.append(first, len(order))))
        told = lambda x: {f"w{i}": pa.array(x[:, i].astype(np.uint32)) for i in range(width - 1)}
        if kept.any():
            out.append((None, _packed(n=pa.array(sums[kept]), **told(ids[order[first[kept]]]))))
        at = 0
        for shard, x in some if width == 3 else ():
            mine = frequent[at : at + x.num_rows]
            if mine.any():
                out.append((shard, _packed(**told(ids[at : at + x.num_rows][mine]))))
            at += x.num_rows
    return pa.table({"shard": pa.array([s for s, _ in out], pa.int64()), "packed": pa.array([x for _, x in out], pa.binary())})


def _frequent(dealt: DataFrame, least: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        return shared.relieved(_summed)(t, least)

    return dealt.groupBy("bucket").applyInArrow(run, "shard long, packed binary")


def _listed(summed: DataFrame) -> DataFrame:
    """a and ids of each frequent phrase."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for x in b["packed"].to_pylist():
                t = _unpacked(pa.chunked_array([[x]]))
                ids = _ids_of(t)
                yield {"a": t["n"].combine_chunks(), "ids": pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * ids.shape[1], pa.array(ids.ravel()))}

    return shared.stream(summed.filter("shard is null").select("packed"), run, "a long, ids array<long>")


def _ask_pairs(items: np.ndarray, answers: pa.Table, buckets: int) -> pa.Table:
    items, ids = _numbered(items, answers)
    pairs, counts = _pairs(items, len(ids))
    return _dealt(answers["of"][0].as_py(), ids[np.column_stack([pairs // len(ids), pairs % len(ids)])], counts, buckets)


def _ask_phrases(items: np.ndarray, answers: pa.Table, buckets: int) -> pa.Table:
    items, ids = _numbered(items, answers)
    got = _unpacked(answers["pairs"].drop_null())
    pairs = np.searchsorted(ids, _ids_of(got)) if got.num_rows else np.zeros((0, 2), np.int64)
    pairs = np.sort(pairs[:, 0] * len(ids) + pairs[:, 1])
    shard, out = answers["of"][0].as_py(), [_dealt(0, np.zeros((0, 3), np.int64), np.zeros(0, np.int64), buckets)]
    held: dict[int, list] = {}
    for phrases, counts in _grown(items, len(ids), pairs):
        held.setdefault(phrases.shape[1], []).append((phrases, counts))
    for parts in held.values():
        out.append(_dealt(shard, ids[np.concatenate([p for p, _ in parts])], np.concatenate([c for _, c in parts]), buckets))
    return pa.concat_tables(out)


def _dense(df: DataFrame, folder: str) -> DataFrame:
    """df saved in folder, with an int id 0, 1, ...: rows are counted by partition, and earlier partitions' counts added."""
    spark = df.sparkSession
    df.withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per task of the write
    starts = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    if starts[-1] >= 1 << 31:
        raise ValueError("more than 2^31 words are frequent; raise `least`")
    first = F.create_map(*(F.lit(x) for r, s in zip(counts, starts, strict=False) for x in (r.part, s))) if counts else F.create_map().cast("map<bigint,bigint>")
    return rows.withColumn("id", (F.element_at(first, part) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("at")


def candidates(docs: DataFrame, least: int = 100, shard_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame, list[str]]:
    """All frequent words and phrases of docs (lang, text), with exact counts.

    Returns (lang, words, a: words of one to five that stand together at least `least` times), (lang, n: all words), and
    the folders that hold what these read, to be discarded once they are used. A null text has no words, a null lang is
    `und`; rows are counted as often as they occur, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    folders = [shared.new_folder(spark, x) for x in ("shards", "words", "ids", "pairs", "phrases")]
    _shards(docs, shard_bytes).write.parquet(folders[0])
    shards = spark.read.parquet(folders[0])
    asked = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select("shard", "code", "lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    # a word has one row per shard, so that no key holds more than a shard's share of the rows
    asked.withColumn("a", F.sum("n").over(Window.partitionBy("lang", "word"))).filter(F.col("a") >= least).write.parquet(folders[1])
    asked = spark.read.parquet(folders[1])
    shared.sweep(spark)
    known = _dense(asked.groupBy("lang", "word").agg(F.first("a").alias("a")), folders[2])
    # a list holds at most the shards of one block
    held = asked.groupBy("lang", "word", (F.col("shard") / BLOCK).cast("long").alias("block")).agg(F.collect_list(F.struct("shard", "code")).alias("x"))
    held = held.join(known.select("lang", "word", "id"), ["lang", "word"]).select("id", F.col("x.shard").alias("shards"), F.col("x.code").alias("codes"))
    words = _answered(held)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    _frequent(_by_shard(shards, words, _ask_pairs, buckets), least).write.parquet(folders[3])
    pairs = spark.read.parquet(folders[3])
    shared.sweep(spark)
    none = F.lit(None).cast("binary")
    answers = words.select("of", "packed", none.alias("pairs")).unionByName(pairs.filter("shard is not null").select(F.col("shard").alias("of"), none.alias("packed"), F.col("packed").alias("pairs")))
    _frequent(_by_shard(shards, answers, _ask_phrases, buckets), least).write.parquet(folders[4])
    shared.sweep(spark)

    phrases = _listed(pairs).unionByName(_listed(spark.read.parquet(folders[4])))
    spelt = phrases.select("a", "ids", F.posexplode("ids").alias("i", "id")).join(known.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("words"))
    single = known.select("lang", F.array("word").alias("words"), "a")
    return single.unionByName(spelt.select("lang", "words", "a")), shards.groupBy("lang").agg(F.sum("n_words").alias("n")), folders


def _spelt(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, shard_bytes: int = 32 << 20) -> DataFrame:
    """The `top` collocations of each language of docs (lang, text).

    A phrase of two to five words with a >= least is a candidate; its score is the least, over its cuts into two parts with
    counts l and r, of floor(1000 * a * n / (l * r)), n being all words of the language; ties go to the earlier cut. A
    candidate inside a longer one that is not rarer is dropped. See `candidates` for nulls, repeats and empty tables.
    Returns lang, rank, phrase, a, l, r, n, score, by score and a (descending) and phrase.
    """
    spark = docs.sparkSession
    found, totals, folders = candidates(docs, least, shard_bytes)
    folders.append(shared.new_folder(spark, "candidates"))
    found.withColumn("phrase", _spelt(F.col("words"))).write.parquet(folders[-1])
    found = spark.read.parquet(folders[-1])
    size = F.size("words")
    phrases = found.filter(size >= 2)
    cut = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _spelt(F.slice("words", F.lit(1), F.col("k"))).alias("head"), _spelt(F.slice("words", F.col("k") + 1, size - F.col("k"))).alias("tail"))
    for side, count in (("head", "l"), ("tail", "r")):
        cut = cut.join(found.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    cut = cut.join(totals, "lang").withColumns({"over": (whole("a") * 1000 * whole("n")).cast("decimal(38,0)"), "under": (whole("l") * whole("r")).cast("decimal(38,0)")})
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*").drop("k")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _spelt(F.slice("words", i, m)))))
    held = found.filter(size >= 3).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = best.join(held, ["lang", "phrase"], "left").filter(F.coalesce("within", F.lit(0)) < F.col("a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = shared.saved(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    shared.discard(spark, *folders)
    return out


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT unnest(range(1, 6)) AS m),
grams AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM words, sizes)),
counted AS (SELECT lang, m, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(f1)::HUGEINT AS n FROM (SELECT lang, len(w) AS f1 FROM words) GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(c.g[1:k], ' ') AS head, array_to_string(c.g[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM counted WHERE m >= 2) c),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, h.f AS l, t.f AS r, n, k, (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts JOIN counted h ON h.lang = cuts.lang AND h.phrase = head JOIN counted t ON t.lang = cuts.lang AND t.phrase = tail JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(g[i:i + j - 1], ' ') AS phrase, max(f) AS within
  FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM counted WHERE m >= 3)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE coalesce(within, 0) < a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
