"""Alignment of two tokenizers' tokens by byte offsets, worked out once per distinct segment.

A is byte-level BPE behind a pattern that never matches from another character into white space; B is BPE over the whole
text. A text is cut before each run of white space that begins with a character which, by B's vocabulary, never
follows another one inside a piece, so that neither can merge across. The cuts are checked from the vocabularies when
an `Aligner` is made. Segments are told apart in Spark, tokenised and aligned once, and joined back to the chunks of
documents that hold them; there documents are composed from them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from . import shared
from .byte_bpe import _chunks, _joined, _packed, _unpacked

#: White space of more than one byte in UTF-8, and characters that some programs take for it: a cut follows none of them.
WIDE = "\x85\xa0 ᠎           ​    　﻿"
PLAIN = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


class Aligner:
    """a: a byte-level file of the tokenizers library; b: a sentencepiece BPE model that puts a space before its text."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        single = _byte_characters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        left = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            left[i] = bytes(single[c] for c in token) if all(c in single for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(len(self.b))]
        right = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        self.cuts = np.zeros(256, bool)
        for w in b" \t\n\x0b\x0c\r":
            inside = any(i and not (w == 0x20 and p[i - 1] == 0x20) for p in right for i in range(len(p)) if p[i] == w)
            inside |= any(1 not in {at for _, (at, _) in self.a.pre_tokenizer.pre_tokenize_str(f"{c}{chr(w)}{d}")} for c in "a1.é¬" for d in "a1. \n")
            self.cuts[w] = not inside
        if self.b.encode("") or self.b.encode("a b") != [*self.b.encode("a"), *self.b.encode("b")]:
            self.cuts[:] = False  # texts then stay whole
        self.bytes_a, self.bytes_b = pa.array(left, pa.binary()), pa.array(right, pa.binary())
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (left, right))
        # decimal ids with what follows them, four of each id of A and B: "1," "1|" and "1," "1;"
        self.text = pa.array([f"{i}{c}".encode() for n, cs in ((len(left), ",|"), (len(right), ",;")) for i in range(n) for c in cs], pa.binary())

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Segments of a space and each text (none of an empty one), one text behind the other; where each text ends."""
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        cuts = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
        data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
        cuts = cuts - cuts[0]
        start = np.zeros(len(data) + 1, bool)
        at = np.flatnonzero(self.cuts[data[1:]] & ~PLAIN[data[:-1]]) + 1
        wide = at[data[at - 1] >= 0x80]
        if len(wide):
            last = np.zeros(len(wide), np.int64)
            for back in (3, 2, 1):
                last = last << 8 | np.where(wide >= back, data[wide - back], 0)
            two, three = ([int.from_bytes(c.encode(), "big") for c in WIDE if len(c.encode()) == n] for n in (2, 3))
            at = np.setdiff1d(at, wide[np.isin(last, three) | np.isin(last & 0xFFFF, two)], assume_unique=True)
        start[at] = True
        start[cuts] = True
        start[len(data)] = False
        at = np.flatnonzero(start)
        found = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)])
        return found, np.searchsorted(at, cuts[1:])

    def _ids_b(self, segments: list[str]) -> list[list[int]]:
        got = self.b.encode([s[1:] if s.startswith(" ") else s for s in segments], num_threads=1)
        # the model's own space stands for that of the segment; where it begins otherwise, it is a token of its own
        return [[self.space] if s == " " else ids if s.startswith(" ") else ids[1:] for s, ids in zip(segments, got, strict=True)]

    def align(self, segments: pa.Array) -> pa.Table:
        """Of each segment: ok, n_a, n_b, n_groups, groups (as text, each group ended by ;), pairs (a << 32 | b of its links).

        ok: the tokens' bytes are those of the segment; else all are zero and empty. A's bytes always are, and B's are
        never more than the segment's, so the tokens of a text have its bytes only where all its segments are ok.
        """
        texts = segments.to_pylist()
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self._ids_b(texts)
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        raw = pc.cast(segments, pa.binary())
        ok = np.ones(len(texts), bool)
        for flat, n, known in ((flat_a, n_a, self.bytes_a), (flat_b, n_b, self.bytes_b)):
            told = _joined(known.take(pa.array(flat)), np.append(0, np.cumsum(n)))
            ok &= np.asarray(pc.equal(told, raw).to_numpy(zero_copy_only=False))
        if not ok.all():
            flat_a, flat_b = flat_a[np.repeat(ok, n_a)], flat_b[np.repeat(ok, n_b)]
            n_a, n_b = n_a * ok, n_b * ok
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        is_last_a, is_last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        is_last_a[last_a] = is_last_b[last_b] = True
        # tokens in the order of the text: those of A, then those of B, of each group
        group = np.concatenate([np.searchsorted(common, end_a) * 2, np.searchsorted(common, end_b) * 2 + 1])
        word = np.concatenate([flat_a * 2 + is_last_a, len(self.len_a) * 2 + flat_b * 2 + is_last_b])
        order = np.argsort(group, kind="stable")
        tokens = np.append(0, np.cumsum(n_a + n_b))
        groups = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), n_a)[last_a], minlength=len(texts))))
        return pa.table(
            {
                "ok": ok, "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups),
                "groups": _joined(self.text.take(pa.array(word[order])), tokens),
                "pairs": pa.ListArray.from_arrays(pa.array(groups, pa.int32()), pa.array(flat_a[last_a] << 32 | flat_b[last_b])),
            }
        )


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_aligners: dict[tuple, Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    key = (a, b, os.getpid())
    if key not in _aligners:
        _aligners[key] = Aligner(a, b)
    return _aligners[key]


def _aligned(segments: DataFrame, a: str, b: str, rows: int = 1 << 15) -> DataFrame:
    """One row per some segments of (segment, n): batch, bad (those not ok), packed (what `align` says), the distinct pairs and their counts by n."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        part, batch, tool = TaskContext.get().partitionId(), 0, aligner(a, b)
        for x in batches:
            for i in range(0, len(x["n"]), rows):
                some, n = x["segment"].slice(i, rows), x["n"].slice(i, rows).to_numpy()
                some = pa.concat_arrays([some])
                got = tool.align(some)
                lists = got["pairs"].combine_chunks()
                pairs, which = np.unique(lists.values.to_numpy(), return_inverse=True)
                counts = np.bincount(which, np.repeat(n, got["n_groups"].to_numpy()), len(pairs)).astype(np.int64)
                codes = pa.ListArray.from_arrays(lists.offsets, pa.array(which.astype(np.int32)))
                bad = some.filter(pc.invert(got["ok"].combine_chunks()))
                one = lambda v: pa.ListArray.from_arrays([0, len(v)], pa.array(v))
                yield {"batch": [part << 32 | batch], "bad": one(bad), "packed": [_packed(segment=some, **{c: got[c].combine_chunks() for c in ("ok", "n_a", "n_b", "n_groups", "groups")}, pairs=codes)], "pairs": one(pairs), "counts": one(counts)}
                batch += 1

    return shared.stream(segments, run, "batch long, bad array<string>, packed binary, pairs array<long>, counts array<long>")


def _chunked(docs: DataFrame, a: str, b: str, chunk_bytes: int) -> DataFrame:
    """One row per part of a partition: its documents (packed), their segments by number, the distinct segments and their counts."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        part, n, tool = TaskContext.get().partitionId(), 0, aligner(a, b)
        for ids, texts in _chunks(batches, chunk_bytes):
            found, ends = tool.segments(texts)
            names, codes, counts = shared.coded(found)
            yield {"chunk": [part << 32 | n], "docs": [_packed(doc_id=ids, ends=pa.array(ends))], "items": [shared.packed_codes(codes)], "segments": pa.ListArray.from_arrays([0, len(names)], names), "counts": pa.ListArray.from_arrays([0, len(names)], pa.array(counts))}
            n += 1

    return shared.stream(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "chunk long, docs binary, items binary, segments array<string>, counts array<long>")


def _lost(chunks: DataFrame, hit: DataFrame) -> DataFrame:
    """How often documents that hold a segment of hit (chunk, code) hold each segment: chunk, code, n."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"chunk": pa.array([], pa.int64()), "code": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})]
        for chunk, docs, items in zip(*(left[c].to_pylist() for c in ("chunk", "docs", "items")), strict=True) if right.num_rows else ():
            codes, ends = shared.unpacked_codes(items), _unpacked(pa.chunked_array([[docs]]))["ends"].to_numpy()
            mine = np.zeros(len(codes) + 1, np.int64)
            mine[1:] = np.cumsum(np.isin(codes, right["code"].to_numpy()))
            each = np.diff(ends, prepend=0)
            odd = np.repeat(mine[ends] > mine[ends - each], each)
            kinds, n = np.unique(codes[odd], return_counts=True)
            out.append(pa.table({"chunk": np.full(len(kinds), chunk), "code": kinds, "n": n}))
        return pa.concat_tables(out)

    return chunks.select("chunk", "docs", "items").groupBy("chunk").cogroup(hit.select(F.col("chunk").alias("of"), "code").groupBy("of")).applyInArrow(run, "chunk long, code int, n long")


def _weighed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A batch's segments with what their documents need: groups, then ok, n_a, n_b, n_groups, n_best (4 bytes each) and count_sum (8)."""
    out = []
    for packed in left["packed"].to_pylist():
        t = _unpacked(pa.chunked_array([[packed]]))
        lists = t["pairs"].combine_chunks()
        codes = lists.values.to_numpy()
        count, best = np.zeros(codes.max(initial=-1) + 1, np.int64), np.zeros(codes.max(initial=-1) + 1, np.int64)
        count[right["code"].to_numpy()], best[right["code"].to_numpy()] = right["count"].to_numpy(), right["best"].to_numpy()
        total = lambda v: np.diff(np.append(0, np.cumsum(v[codes]))[lists.offsets.to_numpy()])
        tail = np.zeros(t.num_rows, "<i4, <i4, <i4, <i4, <i4, <i8")
        for i, v in enumerate([*(t[c].to_numpy() for c in ("ok", "n_a", "n_b", "n_groups")), total(best), total(count)]):
            tail[f"f{i}"] = v
        tail = pa.FixedSizeBinaryArray.from_buffers(pa.binary(28), len(tail), [None, pa.py_buffer(tail.tobytes())]).cast(pa.binary())
        out.append(pa.table({"segment": t["segment"], "told": pc.binary_join_element_wise(t["groups"].combine_chunks(), tail, pa.scalar(b"", pa.binary()))}))
    return pa.concat_tables(out) if out else pa.table({"segment": pa.array([], pa.string()), "told": pa.array([], pa.binary())})


def _dealt(batches: Iterator[dict]) -> Iterator[dict]:
    """What is told of segments, packed for each chunk."""
    hold: list[dict] = []

    def out() -> Iterator[dict]:
        chunk = np.concatenate([b["chunk"].to_numpy() for b in hold])
        code, told = (pa.concat_arrays([b[c] for b in hold]) for c in ("code", "told"))
        order = np.argsort(chunk, kind="stable")
        edge = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            at = pa.array(order[lo:hi])
            yield {"chunk": [int(chunk[order[lo]])], "packed": [_packed(code=code.take(at), told=told.take(at))]}

    for b in batches:
        hold.append(b)
        if sum(len(x["chunk"]) for x in hold) >= 1 << 18:
            yield from out()
            hold.clear()
    if hold:
        yield from out()


def _composed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk from their segments."""
    out, columns = [], ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    told = _unpacked(right["packed"])
    for packed, items in zip(left["docs"].to_pylist(), left["items"].to_pylist(), strict=True):
        docs, codes = _unpacked(pa.chunked_array([[packed]])), shared.unpacked_codes(items)
        ends = docs["ends"].to_numpy()
        if told.num_rows:
            whole = told["told"].combine_chunks().take(pc.sort_indices(told["code"]))
            cuts = np.frombuffer(whole.buffers()[1], np.int32)[: len(whole) + 1].astype(np.int64)
            data = np.frombuffer(whole.buffers()[2], np.uint8)
            tail = data[(cuts[1:, None] - 28 + np.arange(28))].copy().view("<i4, <i4, <i4, <i4, <i4, <i8").ravel()
            text = pc.binary_slice(whole, 0, -28)
        else:
            tail, text = np.zeros(0, "<i4, <i4, <i4, <i4, <i4, <i8"), pa.array([], pa.binary())
        total = lambda v: np.diff(np.append(0, np.cumsum(v.astype(np.int64)[codes]))[np.append(0, ends)])
        ok = total(1 - tail["f0"]) == 0
        sums = dict(zip(columns, (total(tail[f"f{i}"]) * ok for i in (1, 2, 3, 3, 4, 5)), strict=True))
        shas, lo = [], 0
        while lo < len(ends):  # some documents at a time
            low = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, low + (1 << 18), "right")))
            parts = _joined(text.take(pa.array(codes[low : ends[hi - 1]])), np.append(0, ends[lo:hi] - low))
            shas += [hashlib.sha256(x[:-1]).hexdigest() if x else "" for x in parts.to_pylist()]
            lo = hi
        shas = [s if good else "" for s, good in zip(shas, ok, strict=True)]
        out.append(pa.table({"doc_id": docs["doc_id"], **sums, "groups_sha256": pa.array(shas, pa.string())}))
    return pa.concat_tables(out)


def alignments(docs: DataFrame, a: str, b: str, chunk_bytes: int = 32 << 20) -> DataFrame:
    """How the tokens of A and B align in each row of docs (doc_id, text), a space being put before each text.

    Offsets where tokens of both end cut them into groups; the last tokens of a group are linked. A pair's count is the
    number of links that hold it over all rows. Null and empty texts, and those whose tokens' joined bytes differ from the
    text's (as where a text has U+2581, which stands for a space in B), have no tokens: zeros, and no links that count.
    Rows, equal or not, stand and count each for itself; an empty table gives no rows; other columns are ignored.
    a, b: files as for `Aligner`, found at these paths on every machine. chunk_bytes: of text that a task works on at once.
    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B token), count_sum,
    groups_sha256 (of `a1,a2|b1;a3|b2,b3`; an empty string without tokens).
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    session.ship(spark)
    folders = [shared.new_folder(spark, x) for x in ("chunks", "aligned", "pairs", "told")]
    _chunked(docs, a, b, chunk_bytes).write.parquet(folders[0])
    chunks = spark.read.parquet(folders[0])
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("segments", "counts")).alias("code", "x")).select("chunk", "code", F.col("x.segments").alias("segment"), F.col("x.counts").alias("n"))
    _aligned(asked.groupBy("segment").agg(F.sum("n").alias("n")), a, b).write.parquet(folders[1])
    aligned = spark.read.parquet(folders[1])

    linked = aligned.select("batch", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "x")).select("batch", "code", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    bad = aligned.select(F.explode("bad").alias("segment"))
    counted = linked.select("pair", "n")
    if not bad.isEmpty():  # take back what the rows without tokens have counted
        lost = _lost(chunks, asked.join(bad, "segment").select("chunk", "code"))
        lost = lost.join(asked.select("chunk", "code", "segment"), ["chunk", "code"]).groupBy("segment").agg((-F.sum("n")).alias("n"))
        back = _aligned(lost, a, b).select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
        counted = counted.unionByName(back)
    counts = counted.groupBy("pair").agg(F.sum("n").alias("count"))
    # a B token is linked with at most as many tokens as A has
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    counts.withColumn("best", (F.col("count") == most).cast("int")).write.parquet(folders[2])
    known = linked.select("batch", "code", "pair").join(spark.read.parquet(folders[2]), "pair").drop("pair")

    def weighed(left: pa.Table, right: pa.Table) -> pa.Table:
        return shared.relieved(_weighed)(left, right)

    def composed(left: pa.Table, right: pa.Table) -> pa.Table:
        return shared.relieved(_composed)(left, right)

    known = known.select(F.col("batch").alias("of"), "code", "count", "best")
    told = aligned.select("batch", "packed").groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(weighed, "segment string, told binary")
    told.write.parquet(folders[3])
    told = spark.read.parquet(folders[3])
    shared.discard(spark, *folders[1:3])
    shared.sweep(spark)
    back = shared.stream(asked.select("chunk", "code", "segment").join(told, "segment").select("chunk", "code", "told"), _dealt, "chunk long, packed binary").withColumnRenamed("chunk", "of")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.select("chunk", "docs", "items").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(composed, schema)
