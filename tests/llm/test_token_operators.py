"""Token files, collocations and alignments against brute force: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from strandloom.llm import alignment, collocations, shared, token_files

SCHEMA = "doc_id long, text string, lang string, part string, offset int, items string, code int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    r = random.Random(3)
    vocabulary = [r.choice(["Ab", "dé", "İx", "o'c", "Ñu", "x2y", "ß9"]) + "ka"[: i % 3] * (i % 4) for i in range(90)]
    texts = [" ".join(r.choice(vocabulary) + r.choice(["", "", ",", ". ", "\n", "!!"]) for _ in range(r.randint(1, 250))) for _ in range(70)]
    texts += ["", None, "  \n ", " ", "one", "a b▁c d", "tab\tand\x0bline\r\nends;\r {\r", "長い 文 " * 60, "<|endoftext|> <|startoftext|>x </s> <0x41>", "I'm  it's\n\n x　y\xa0z ​ w", "é ñ ×÷ 12 3a", "x" * 3000, "word " * 4000, "\n lead\n\nq  ", "\x1cé,İ, İ'ſ"]
    rows = [(i, t, [None, "en", "de"][i % 3], "clash", 1, "x", 2) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id here", "en", "c", 1, "x", 2), (5, "same id, other text", "en", "c", 1, "x", 2)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_token_files(spark, docs, rows, nothing, ids_of):
    folder = shared.new_folder(spark, "tokens")
    token_files.write(docs, folder, WORDS, end=1, frame=64, chunk_bytes=1 << 12)
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert [g.doc_id for g in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at, want = 0, Counter((i, *ids_of(t)) for i, t, *_ in rows)
    for g in got:
        ids = np.frombuffer(g.ids, "<u4").tolist()
        assert (g.start, g.n_tokens) == (at, len(ids))
        want[g.doc_id, *ids] -= 1
        at += len(ids)
    assert not +want
    asked = spark.createDataFrame([(1,), (1,), (82,), (None,), (12345,)], "doc_id long")
    found = {r.doc_id: r for r in token_files.lookup(asked, folder).collect()}
    assert set(found) == {1, 82}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids_of(rows[i][1]) for i, r in found.items())
    assert all(r.frames <= r.n_tokens // 64 + 2 for r in found.values())
    empty = shared.new_folder(spark, "tokens")
    token_files.write(nothing, empty, WORDS, end=1)
    assert token_files.read(spark, empty).count() == 0


def test_frames_are_plain_zstandard_and_checked():
    import pyarrow as pa

    r, out = np.random.default_rng(1), io.BytesIO()
    ids = r.integers(0, 60000, 1000).astype("<u2")
    w = token_files.FrameWriter(out, ids.dtype, 128, 3)
    w.add(ids[:300])
    w.add(ids[300:])
    w.close(pa.table({"doc_id": [4, 5], "n_tokens": [300, 700]}))
    data = out.getvalue()
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as f:
        assert f.read() == ids.tobytes()
    reader = token_files.FrameReader(io.BytesIO(data), len(data))
    assert (reader.ids(250, 20) == ids[250:270]).all() and reader.frames_read == 2
    assert (reader.ids(0, 1000) == ids).all() and len(reader.ids(7, 0)) == 0
    reader = token_files.FrameReader(io.BytesIO(data), len(data))
    reader.table[3, 2] ^= 1
    reader.ids(0, 384)
    with pytest.raises(ValueError, match="frame 3"):
        reader.ids(384, 1)


def counted(rows):
    counts, totals = Counter(), Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    return counts, totals


def test_collocations(docs, rows, nothing):
    least, top = 3, 40
    counts, n = counted(rows)
    found = {k: a for k, a in counts.items() if a >= least}
    held = defaultdict(int)
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                held[lang, w[i : i + m]] = max(held[lang, w[i : i + m]], a)
    by = defaultdict(list)
    for (lang, w), a in found.items():
        if len(w) > 1 and held[lang, w] < a:
            score, k = min((1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    want = {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in by.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top])}
    assert set(by) == {"und", "en", "de"} and any(len(w) == 5 for _, w in found)
    for shard in (1 << 11, 1 << 24):
        got = collocations.collocations(docs, least, top, shard).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert collocations.collocations(nothing, least).count() == 0


def test_scores_beyond_64_bits(spark):
    n = F.lit(4 * 10**12).cast("long")
    row = spark.range(1).select(n.alias("a"), n.alias("n"), F.lit(3).cast("long").alias("l"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    got = row.select((whole("a") * 1000 * whole("n")).cast("decimal(38,0)").alias("over"), (whole("l") * whole("a")).cast("decimal(38,0)").alias("under")).select(F.expr("over div under").alias("x")).first().x
    assert got == 1000 * 4 * 10**12 // 3


def test_phrases_depth_first_in_small_runs():
    r = np.random.default_rng(5)
    items = r.integers(-1, 4, 3000).astype(np.int32)
    n = 4
    pairs, counts = collocations._pairs(items, n)
    keep = pairs[counts >= 100]
    ok = lambda g: min(g) >= 0 and all(a * n + b in keep for a, b in zip(g, g[1:], strict=False))
    want = Counter(g for m in (3, 4, 5) for g in zip(*(items[i : len(items) - m + 1 + i].tolist() for i in range(m)), strict=True) if ok(g))
    for rows in (1, 1 << 18):
        got = Counter()
        for phrases, each in collocations._grown(items, n, keep, rows=rows):
            got.update({tuple(p): c for p, c in zip(phrases.tolist(), each.tolist(), strict=True)})
        assert got == want


def aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    single, out, counts = alignment._byte_characters(), [], Counter()
    for i, text, *_ in rows:
        a, b = ta.encode(" " + (text or ""), add_special_tokens=False), tb.encode(text or "")
        left = [bytes(single[c] for c in t) for t in a.tokens]
        right = [bytes([int(tb.id_to_piece(k)[3:5], 16)]) if tb.is_byte(k) else tb.id_to_piece(k).replace("▁", " ").encode() for k in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(left) != whole or b"".join(right) != whole:
            out.append((i, 0, 0, [], ""))
            continue
        ends = [dict(zip(np.cumsum(list(map(len, x))).tolist(), range(1, len(x) + 1), strict=True)) for x in (left, right)]
        links, groups, p, q = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            groups.append(",".join(map(str, a.ids[p : ends[0][e]])) + "|" + ",".join(map(str, b[q : ends[1][e]])))
            p, q = ends[0][e], ends[1][e]
            links.append((a.ids[p - 1], b[q - 1]))
        counts.update(links)
        out.append((i, len(left), len(right), links, ";".join(groups)))
    most = Counter()
    for (_, q), c in counts.items():
        most[q] = max(most[q], c)
    return Counter((i, na, nb, len(ls), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, ls, g in out)


@pytest.mark.parametrize("chunk", [1 << 12, 1 << 24])
def test_alignments(docs, rows, chunk):
    want = aligned(rows)
    assert sum(w[1] == 0 for w in want) >= 3
    assert Counter(map(tuple, alignment.alignments(docs, A, B, chunk).collect())) == want


def test_alignments_of_nothing(nothing):
    assert alignment.alignments(nothing, A, B).count() == 0


def test_cuts_follow_the_vocabularies():
    cuts = np.flatnonzero(alignment.Aligner(A, B).cuts).tolist()
    assert 32 in cuts and 10 in cuts and 13 not in cuts  # B has pieces such as ";\r"
