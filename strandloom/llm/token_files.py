"""Token ids in binary files of independent zstandard frames, which a reader opens at any document.

A file is a run of frames of equally many ids (the last may hold fewer), then a skippable frame with the index of its
documents (an Arrow stream of doc_id and n_tokens), then the seek table in the published seekable format: one entry per
frame (compressed size, size, checksum of the content) and a footer of fixed size. Any zstandard reader gets the plain
ids; `lookup` reads footer, table and the few frames that hold the documents asked for, and checks each frame's sum.

Documents lie in ascending order of doc_id over all files: rows are dealt by ranges of the id and sorted inside them. One
row per document goes into a Parquet index beside the files; files of failed attempts are in no index and never read.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .byte_bpe import _chunks

#: Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE, HAS_SUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

WHITE, LETTER, DIGIT, MARK, ODD = range(5)


def _classes() -> np.ndarray:
    """The class of each byte: odd are those whose word is left to the library as a whole."""
    c = np.full(256, ODD, np.uint8)
    c[33:127] = MARK
    c[[9, 10, 11, 12, 13, 32]] = WHITE
    c[48:58] = DIGIT
    c[65:91] = c[97:123] = LETTER
    c[[ord("'"), ord("<")]] = ODD  # contractions and the strings of special tokens
    return c


CLASS = _classes()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts that can be encoded apart, one text behind the other; where each text ends among them.

    For tokenizers that lower-case, drop white space and take letters, single digits and other marks apart. White space
    ends a piece, and so does a change between letters (ASCII and U+00C0 to U+017F), digits and marks. A word that has
    anything else (an apostrophe, <, other letters, combining marks) is one piece, left as it is.
    """
    cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    kind = CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    after = data[lead + 1]
    # × and ÷ are no letters; the lower case of U+0130 has a combining mark
    lead = lead[~((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (data[lead] == 0xC4) & (after == 0xB0))]
    kind[lead] = kind[lead + 1] = LETTER
    first = np.zeros(len(data), bool)
    first[cuts[:-1][cuts[:-1] < len(data)]] = True
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        white = kind == WHITE
        edge = first.copy()
        edge[1:] |= white[1:] != white[:-1]
        edge = np.append(np.flatnonzero(edge), len(data))
        edge = edge if edge[0] == 0 else np.append(0, edge)
        own = np.unique(np.searchsorted(edge, odd, "right") - 1)
        span = np.zeros(len(data) + 1, np.int8)
        np.add.at(span, edge[own], 1)
        np.add.at(span, edge[own + 1], -1)
        kind[np.cumsum(span[:-1], dtype=np.int8) > 0] = ODD
    start = first
    start[0] = True
    start[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    keep = kind != WHITE
    start &= keep
    start = np.flatnonzero(start)
    data = np.where(kind == LETTER, LOWER[data], data)[keep]
    at = np.append(np.cumsum(keep, dtype=np.int32)[start] - 1, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data)])
    return found, np.searchsorted(start, cuts[1:])


class PieceEncoder:
    """Encodes texts by their distinct pieces, with the ids of pieces met before kept in this process.

    path: a tokenizer file of the tokenizers library whose splitting `pieces` respects; dtype: of the ids, as bytes.
    most: pieces kept, at about 30 bytes each; when they are more, those of the last texts stay.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._known, self._ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _encoded(self, some: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(some), 4096):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(some.slice(i, 4096).to_pylist(), add_special_tokens=False)]
            flat = np.fromiter((x for ids in got for x in ids), self.dtype)
            at = np.cumsum([0, *map(len, got)], dtype=np.int32) * self.dtype.itemsize
            parts.append(pa.Array.from_buffers(pa.binary(), len(got), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text behind the other, each followed by `end` if given; how many each text has."""
        found, ends = pieces(texts)
        coded = found.dictionary_encode()
        names = coded.dictionary
        at = pc.index_in(names, value_set=self._known)
        new = names.filter(pc.is_null(at))
        if len(new):
            if len(self._known) + len(new) > self.most:
                old = names.filter(pc.is_valid(at))
                self._ids, self._known = self._ids.take(at.drop_null()), old
            self._known = pa.concat_arrays([self._known, new])
            self._ids = pa.concat_arrays([self._ids, self._encoded(new)])
            at = pc.index_in(names, value_set=self._known)
        ids = self._ids.take(at).take(coded.indices)
        cuts = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        flat = np.frombuffer(ids.buffers()[2] or b"", self.dtype)[: cuts[-1] // self.dtype.itemsize]
        each = np.diff(cuts[np.append(0, ends)] // self.dtype.itemsize)
        if end is not None:
            flat = np.insert(flat, np.cumsum(each), end)
            each = each + 1
        return flat, each.astype(np.int64)


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this process for a file: its pieces serve later tasks too."""
    key = (path, os.getpid())
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path)
    return _encoders[key]


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder; file:/x, as Spark writes it, is file:///x."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class FrameWriter:
    """Ids to one file: frames of `frame` ids, the documents' index, the seek table."""

    def __init__(self, out: io.RawIOBase, dtype: np.dtype, frame: int, level: int):
        self.out, self.dtype, self.size = out, dtype, frame
        self.press, self.table = zstandard.ZstdCompressor(level=level), bytearray()
        self.rest, self.n = np.zeros(0, dtype), 0

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.tobytes()
        packed = self.press.compress(raw)
        self.out.write(packed)
        self.table += struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.n += 1

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.rest, ids]).astype(self.dtype)
        whole = len(ids) // self.size * self.size
        for i in range(0, whole, self.size):
            self._frame(ids[i : i + self.size])
        self.rest = ids[whole:].copy()

    def close(self, index: pa.Table) -> None:
        if len(self.rest):
            self._frame(self.rest)
        sink = pa.BufferOutputStream()
        index = index.replace_schema_metadata({"itemsize": str(self.dtype.itemsize), "frame": str(self.size)})
        with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as f:
            f.write_table(index)
        body = sink.getvalue().to_pybytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.table += struct.pack("<III", len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        footer = struct.pack("<IBI", self.n + 1, HAS_SUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(self.table) + len(footer)) + self.table + footer)


class FrameReader:
    """One file, opened at its end: the seek table, the documents' index, then only the frames asked for."""

    def __init__(self, source: io.RawIOBase, size: int):
        self.source, self.frames_read = source, 0
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & HAS_SUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        source.seek(int(self.at[n - 1]) + 8)
        self.index = pa.ipc.open_stream(source.read(int(self.table[n - 1, 0]) - 8)).read_all()
        meta = self.index.schema.metadata
        self.dtype = np.dtype(f"<u{meta[b'itemsize'].decode()}")
        self.ends = np.cumsum(self.table[:-1, 1] // self.dtype.itemsize)
        self._press = zstandard.ZstdDecompressor()
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, self.dtype))

    def _frame(self, i: int) -> np.ndarray:
        if self._last[0] != i:
            self.source.seek(int(self.at[i]))
            raw = self._press.decompress(self.source.read(int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
            if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
                raise ValueError(f"frame {i} doesn't have the content that its checksum states")
            self.frames_read += 1
            self._last = (i, np.frombuffer(raw, self.dtype))
        return self._last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th of this file."""
        out, i = [], int(np.searchsorted(self.ends, start, "right"))
        while n > 0:
            low = int(self.ends[i - 1]) if i else 0
            part = self._frame(i)[start - low : start - low + n]
            out.append(part)
            start, n, i = start + len(part), n - len(part), i + 1
        return np.concatenate(out) if out else np.zeros(0, self.dtype)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = None, *, frame: int = 1 << 16, level: int = 3, chunk_bytes: int = 8 << 20) -> None:
    """Encodes the whole texts of docs (doc_id, text) and writes them to folder in ascending order of doc_id.

    tokenizer: a file of the tokenizers library (see `pieces`), found at this path on every machine. end: an id behind
    each document. frame: ids a frame; chunk_bytes: of text that a task works on at once.
    Null texts count as empty. Null ids come first; rows of one id lie in the order of their texts' hashes, and equal rows
    are written as often as they occur. An empty table gives an index without rows. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    text = F.coalesce("text", F.lit(""))
    # the last column parts equal rows, of which there may be many
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("rk"), (F.monotonically_increasing_id() % 1024).alias("nth"))
    order = ["doc_id", "rk", "nth"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encode, out, place = encoder(tokenizer), None, ""
        part, start, index = TaskContext.get().partitionId(), 0, []
        for ids, texts in _chunks(batches, chunk_bytes):
            if out is None:
                fs, at = _opened(folder)
                fs.create_dir(f"{at}/files", recursive=True)
                place = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
                out = fs.open_output_stream(f"{at}/files/{place}", compression=None)
                file = FrameWriter(out, encode.dtype, frame, level)
            flat, each = encode(texts, end)
            file.add(flat)
            index.append(pa.table({"doc_id": ids, "n_tokens": each}))
            yield {"doc_id": ids, "part": np.full(len(ids), part, np.int32), "file": [place] * len(ids), "offset": start + np.cumsum(each) - each, "n_tokens": each}
            start += int(each.sum())
        if out is not None:
            file.close(pa.concat_tables(index))
            out.close()

    shared.stream(dealt, run, f"doc_id {kind}, part int, file string, offset long, n_tokens long").write.parquet(f"{folder}/index")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: part, file, docs, tokens and start, the ids in all files before it.

    What the driver gathers is a row per file, which is many megabytes of ids.
    """
    index = spark.read.parquet(f"{folder}/index")
    rows = index.groupBy("part", "file").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).orderBy("part").collect()
    starts = np.cumsum([0, *(r.tokens for r in rows)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts, strict=False)], "part int, file string, docs long, tokens long, start long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document from the files alone: doc_id, start (ids of all before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    kind = dict(spark.read.parquet(f"{folder}/index").dtypes)["doc_id"].replace("bigint", "long")
    listed = files(spark, folder)
    n = max(1, listed.count())

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        fs, at = _opened(folder)
        for b in batches:
            for place, first in zip(b["file"].to_pylist(), b["start"].to_pylist(), strict=True):
                path = f"{at}/files/{place}"
                with fs.open_input_file(path) as f:
                    file = FrameReader(f, fs.get_file_info(path).size)
                    each = file.index["n_tokens"].to_numpy()
                    ends = np.cumsum(each)
                    lo = 0
                    while lo < len(each):  # some documents at a time
                        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - each[lo] + (1 << 20), "right")))
                        low = int(ends[lo] - each[lo])
                        flat = file.ids(low, int(ends[hi - 1]) - low).astype("<u4")
                        cuts = np.append(0, ends[lo:hi] - low)
                        parts = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(flat)])
                        yield {"doc_id": file.index["doc_id"].slice(lo, hi - lo).combine_chunks(), "start": first + low + cuts[:-1], "n_tokens": each[lo:hi], "ids": parts}
                        lo = hi

    return shared.stream(listed.repartitionByRange(n, "part"), run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def lookup(wanted: DataFrame, folder: str) -> DataFrame:
    """The documents whose doc_id is in `wanted` (once, however often it is asked for; null asks for nothing).

    Only frames that hold them are read and decompressed. Returns doc_id, n_tokens, ids (as `read`), frames (read for it and
    not for the one before).
    """
    spark = wanted.sparkSession
    index = spark.read.parquet(f"{folder}/index")
    kind = dict(index.dtypes)["doc_id"].replace("bigint", "long")
    found = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        fs, at = _opened(folder)
        now, f, file = None, None, None
        for b in batches:
            out = []
            for doc, place, offset, n in zip(*(b[c].to_pylist() for c in ("doc_id", "file", "offset", "n_tokens")), strict=True):
                if place != now:
                    if f is not None:
                        f.close()
                    path = f"{at}/files/{place}"
                    f = fs.open_input_file(path)
                    now, file = place, FrameReader(f, fs.get_file_info(path).size)
                before = file.frames_read
                out.append((doc, n, file.ids(offset, n).astype("<u4").tobytes(), file.frames_read - before))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield dict(zip(("doc_id", "n_tokens", "ids", "frames"), map(list, columns), strict=True))
        if f is not None:
            f.close()

    return shared.stream(found.repartition("file").sortWithinPartitions("file", "offset"), run, f"doc_id {kind}, n_tokens long, ids binary, frames int")
