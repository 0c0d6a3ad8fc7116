"""Suffix-array dedup over bytes with a run-length index.

The corpus is cut into segments by content (windows.py), so that equal strings of `length` bytes always
lie in segments with equal anchors. Segments that share an anchor but differ are laid into one text per
batch; its Burrows-Wheeler transform is kept as runs with suffix samples at both ends of each run, and
matching statistics - the longest match of each place with any other - are streamed from these samples.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, windows

U = np.uint64
END = 0xFF  # no byte of UTF-8
TABLE = windows.mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of some texts, with sampled suffixes at the runs' ends.

    text: the texts, each with END behind it. heads, tails: first and last row of each run; at_head,
    at_tail: suffixes there; up, down: how far the suffix at a head (tail) agrees with that of the row
    before (after). Each text's END is a symbol of its own, so no two suffixes tie and their order is exact.
    """

    def __init__(self, texts: list[bytes]):
        self.text = t = np.frombuffer(bytes([END]).join([*texts, b""]), np.uint8)
        n = len(t)
        size = np.array([len(x) + 1 for x in texts])
        ends = np.cumsum(size) - 1
        which = np.repeat(np.arange(len(texts)), size)
        left = ends[which] - np.arange(n)  # bytes before the text's end
        key = np.zeros(n, U)
        padded = np.concatenate([t, np.zeros(8, np.uint8)])
        for j in range(8):
            key = (key << U(8)) | padded[j : j + n].astype(U)
        levels = [(1, (key >> U(56)).astype(np.uint8)), (2, (key >> U(48)).astype(np.uint16)), (4, (key >> U(32)).astype(np.uint32))]
        ended = left < 8
        blank = U(8) * (U(7) - left[ended].astype(U))
        key[ended] = key[ended] >> blank << blank
        rank, span = self._ranks(self._ranks(key) * (len(texts) + 1) + np.where(ended, which + 1, 0)), 8
        levels.append((8, rank.astype(np.int32)))
        while rank.max() + 1 < n:
            behind = np.zeros(n, np.int64)
            behind[: n - span] = rank[span:] + 1
            rank = self._ranks(rank * (n + 1) + behind)
            span *= 2
            levels.append((span, rank.astype(np.int32)))
        order = np.argsort(rank, kind="stable")
        bwt = t[order - 1].astype(np.int64)
        first = np.isin(order, ends - size + 1)
        bwt[first] = -1 - which[order[first]]
        new = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.heads = np.flatnonzero(new)
        self.tails = np.append(self.heads[1:] - 1, n - 1)
        self.runs = bwt[self.heads]
        self.at_head, self.at_tail = order[self.heads], order[self.tails]
        self.up = self._agree(levels, self.at_head, order[np.maximum(self.heads - 1, 0)], self.heads > 0)
        self.down = self._agree(levels, self.at_tail, order[np.minimum(self.tails + 1, n - 1)], self.tails < n - 1)

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        return rank

    def _agree(self, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> np.ndarray:
        n = len(self.text)
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        ok = ok.copy()
        for span, rank in [levels[-1], *levels[::-1]]:
            live = ok & (np.maximum(a, b) < n)
            same = np.zeros(len(a), bool)
            same[live] = rank[a[live]] == rank[b[live]]
            for x in (a, b, total):
                x[same] += span
        return total

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text, the longest agreement with a suffix that starts elsewhere.

        Within a run the agreement with the row before (after) shrinks by one from place to place, so it
        streams from the nearest sample on the left. Agreements may run past a text's end; callers cut them.
        """
        best = np.zeros(len(self.text), np.int64)
        for at, value in ((self.at_head, self.up), (self.at_tail, self.down)):
            sample = np.full(len(self.text), -1, np.int64)
            sample[at] = value
            here = np.arange(len(self.text))
            last = np.maximum.accumulate(np.where(sample >= 0, here, -1))
            best = np.maximum(best, np.where(last >= 0, sample[last] - (here - last), 0))
        return best


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the starts of its strings of `length` bytes that start elsewhere in the texts too."""
    if not texts:
        return []
    stat = RunLengthIndex(texts).matching_statistics()
    out, at = [], 0
    for t in texts:
        room = len(t) - length + 1
        out.append(np.flatnonzero(stat[at : at + max(room, 0)] >= length))
        at += len(t) + 1
    return out


def window_hashes(text: bytes, length: int) -> np.ndarray:
    """Of every string of `length` bytes in a text that has at least one."""
    s = TABLE[np.frombuffer(text, np.uint8)]
    up, down = windows.powers(len(s) + 1)
    prefix = np.concatenate([np.zeros(1, U), np.cumsum(s * up[: len(s)], dtype=U)])
    return windows.mix((prefix[length:] - prefix[:-length]) * down[: len(s) - length + 1])


def byte_symbols(batches):
    for b in batches:
        yield b, ((row, TABLE[np.frombuffer(text, np.uint8)]) for row, text in enumerate(shared.as_bytes(b["text"])))


def repeats(docs: DataFrame, length: int, shingle: int, width: int, most_kinds: int) -> DataFrame:
    """Of keyed documents, those with repeated strings: doc_id, rk and where, as windows.repeated() gives it."""
    plan = windows.Plan(byte_symbols, length, min(shingle, length), most=1 << 18, width=width)

    def detail(b, g, ok, doc, pos):
        texts: dict[int, bytes] = {}
        seen, keep, out = set(), [], []
        for j, (i, d, p) in enumerate(zip(ok.tolist(), doc.tolist(), pos.tolist(), strict=True)):
            key = (int(g.anchor[i]), int(g.content[i]))
            if key in seen:
                continue
            seen.add(key)
            if d not in texts:
                texts[d] = b["text"][d].as_buffer().to_pybytes()
            keep.append(j)
            out.append(texts[d][p : p + int(g.n_windows[i]) + length - 1])
        ok = ok[keep]
        yield {"anchor": windows._long(g.anchor[ok]), "content": windows._long(g.content[ok]), "bytes": out}

    def by_index(batches):
        hold: list[tuple[int, int, int, bytes]] = []

        def found():
            got = repeated_starts([x[3] for x in hold], length)
            rows = [(x[0], x[1], s) for x, s in zip(hold, got, strict=True) if x[2] == 1 and len(s)]
            yield {"anchor": [x[0] for x in rows], "content": [x[1] for x in rows], "offs": [x[2].tolist() for x in rows]}

        size, last = 0, None
        for b in batches:
            for anchor, content, n, text in zip(b["anchor"].to_pylist(), b["content"].to_pylist(), b["n"].to_pylist(), shared.as_bytes(b["bytes"]), strict=True):
                if size >= 1 << 18 and anchor != last:
                    yield from found()
                    hold, size = [], 0
                hold.append((anchor, content, n, text))
                size, last = size + len(text), anchor
        if hold:
            yield from found()

    def windows_of(batches, keep=None):
        for b in batches:
            hashes = [window_hashes(text, length) for text in shared.as_bytes(b["bytes"])]
            each = [len(h) for h in hashes]
            out = {c: np.repeat(np.asarray(b[c]), each) for c in ("anchor", "content", "n")}
            out["off"] = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in each]])
            out["h"] = windows._long(np.concatenate([np.zeros(0, U), *hashes]))
            ok = slice(None) if keep is None else keep(window_keys(out))
            yield {c: v[ok] for c, v in out.items()}

    def window_keys(x):
        return windows.mix(x["h"].view(U) ^ x["anchor"].view(U))

    def hot_windows(many: DataFrame) -> DataFrame:
        """Rows for an exact group-by: of segments with too many kinds, the windows that a sketch can't rule out."""

        def keys(batches):
            for x in windows_of(batches):
                k = window_keys(x)
                yield np.concatenate([k, k[x["n"] > 1]])

        seen = many.sparkSession.sparkContext.broadcast(windows.merged_sketch(many, keys, 2, width, 2))
        return shared.stream(many, lambda batches: windows_of(batches, seen.value.passes), "anchor long, content long, n long, off int, h long")

    def resolve(parts: DataFrame, _: DataFrame) -> DataFrame:
        parts = parts.select("anchor", "content", "n", "kinds", "bytes")
        few = parts.filter(F.col("kinds") <= most_kinds).drop("kinds")
        few = few.repartition("anchor").sortWithinPartitions("anchor", "content")
        many = shared.saved(parts.filter(F.col("kinds") > most_kinds).drop("kinds"))
        return shared.stream(few, by_index, "anchor long, content long, offs array<int>").unionByName(windows.by_window_hash(hot_windows(many)))

    return windows.repeated(docs, plan, resolve, detail, "anchor long, content long, bytes binary")


def repeated_bytes(docs: DataFrame, length: int = 200, shingle: int = 64, width: int = 26, most_kinds: int = 8192) -> DataFrame:
    """One row per row of docs (doc_id, text): what is left without bytes of repeated strings.

    Texts are UTF-8 bytes. Each byte that lies in a string of `length` bytes which also starts anywhere
    else - in the same document or another; equal rows count as two documents - goes. Overlaps count,
    strings are judged on the input, and no match crosses documents. Null and empty texts have no bytes;
    texts shorter than `length` lose nothing; an empty table gives no rows; null ids are judged as any
    other. Other columns of docs are ignored.

    Returns doc_id, n_bytes, n_removed, n_spans, starts and stops of the removed spans, kept (bytes),
    kept_sha256.

    most_kinds: an anchor with more different segments than this isn't laid into an index, whose text must
    stay in memory (3 MB of text at the default); its windows are grouped exactly by content, which spreads
    over all tasks, after a second sketch has ruled out those that occur once.
    """
    docs = shared.keyed_documents(docs)
    found = repeats(docs, length, shingle, width, most_kinds)
    texts = shared.packed(docs)
    joined = texts.join(found, shared.same_row(texts, found), "left").select(texts["doc_id"], texts["text"], found["found"])

    def cut(batches):
        for b in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "starts", "stops", "kept", "kept_sha256")}
            for text, f in zip(shared.unpacked(b["text"]), b["found"].to_pylist(), strict=True):
                starts = stops = np.zeros(0, np.int64)
                kept = text
                if f:
                    gone = windows.covered(len(text), length, f)
                    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for k, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", len(starts)), ("starts", starts.tolist()), ("stops", stops.tolist()), ("kept", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"]} | out

    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    return shared.stream(joined, cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, starts array<int>, stops array<int>, kept binary, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 200, shingle: int = 64, width: int = 26, most_kinds: int = 8192) -> DataFrame:
    """The rows of docs, all columns, with text cut as by repeated_bytes() and n_chars, if there, counted anew.

    A character of which a cut has left only some bytes goes too.
    """
    keys = shared.keyed_documents(docs)
    key, of_id, of_key, spots = shared.fresh(docs, "_key", "_of_id", "_of_key", "_found")
    found = repeats(keys, length, shingle, width, most_kinds).withColumnsRenamed({"doc_id": of_id, "rk": of_key, "found": spots})
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found[of_id]) & (keyed[key] == found[of_key]), "left").drop(key, of_id, of_key)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, f in zip(shared.as_bytes(batch["text"]), batch[spots].to_pylist(), strict=True):
            if f:
                text = np.frombuffer(text, np.uint8)[~windows.covered(len(text), length, f)].tobytes()
            texts.append(None if text is None else text.decode("utf-8", "ignore"))
        at = batch.schema.get_field_index("text")
        out = batch.set_column(at, "text", pa.array(texts, batch.schema.field("text").type))
        return out.drop_columns([spots])

    out = shared.rewrite(joined, cut, (spots,))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
