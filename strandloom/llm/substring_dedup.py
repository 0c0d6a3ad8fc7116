"""Substring dedup over words: removes each word that lies in a window of words which occurs again.

Count-min prefilter: partition sketches, merged, overestimate how often a window occurs; a second pass
groups exactly only the windows estimated to repeat. See windows.py for the search.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, windows


class WordHashes(dict):
    """Number of each word, in order of arrival; hashes: a 64-bit hash of each."""

    def __init__(self):
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.hashes, np.uint64)[ids] if len(ids) else ids.view(np.uint64)


def word_symbols(batches):
    """For windows.Plan: the words of each text as 64-bit hashes."""
    known = WordHashes()
    for b in batches:

        def each(b=b):
            nonlocal known
            for row, text in enumerate(shared.as_bytes(b["text"])):
                words = text.split()
                if len(known) > 1 << 19:
                    known = WordHashes()
                yield row, known.of(words)

        yield b, each()


def repeated_words(docs: DataFrame, window: int = 35, shingle: int = 8, width: int = 26) -> DataFrame:
    """One row per row of docs (doc_id, text): what is left without words of repeated windows.

    Words are maximal runs of bytes other than ASCII white space, unchanged. A window is `window`
    consecutive words of one document; it repeats if the same words start anywhere else, in the same
    document or another (equal rows count as two documents). Windows are judged on the input. Null and empty texts
    have no words; documents shorter than a window lose nothing; an empty table gives no rows. Rows with a
    null doc_id are judged as any other. Other columns of docs are ignored.

    Returns doc_id, n_words, n_removed, kept (words joined by a space), kept_sha256.
    width: log2 of the cells in each of the sketch's two rows; the driver and each Python worker hold
    2 * 2**width / 8 bytes (16 MB by default) at any size of the input.
    """
    plan = windows.Plan(word_symbols, window, min(shingle, window), width=width)

    def detail(_, g, ok, doc, pos):
        hashes, n = g.window_hashes(ok, window)
        cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        yield {"anchor": windows._long(g.anchor[ok]), "content": windows._long(g.content[ok]), "hashes": pa.ListArray.from_arrays(pa.array(cut), pa.array(windows._long(hashes)))}

    docs = shared.keyed_documents(docs)
    found = windows.repeated(docs, plan, lambda parts, _: windows.by_window_hash(parts.select("anchor", "content", "n", F.posexplode("hashes").alias("off", "h"))), detail, "anchor long, content long, hashes array<long>")
    texts = shared.packed(docs)
    joined = texts.join(found, shared.same_row(texts, found), "left").select(texts["doc_id"], texts["text"], found["found"])

    def cut(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_words": [], "n_removed": [], "kept": [], "kept_sha256": []}
            for text, f in zip(shared.unpacked(b["text"]), b["found"].to_pylist(), strict=True):
                words = text.split()
                n = 0
                if f:
                    gone = windows.covered(len(words), window, f)
                    n = int(gone.sum())
                    words_left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    words_left = words
                kept = b" ".join(words_left)
                out["n_words"].append(len(words))
                out["n_removed"].append(n)
                out["kept"].append(kept.decode())
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield out

    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    return shared.stream(joined, cut, f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
