"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import byte_bpe, decontaminate, near_dedup, ppm, shared, substring_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, rk string, anchor int, found string"


def corpus(seed=7, n=60):
    """Random words of a small vocabulary, copies, near copies, shared passages and odd rows."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" + r.choice(["", "é", "x" * (i % 7)]) for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = []
    for i in range(n):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 180)))
        if i % 5 == 0:
            t = t + " " + passage + " end" + str(i)
        if i % 7 == 0 and texts:
            t = texts[-1]
        if i % 11 == 0 and texts:
            w = texts[-1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts += ["", None, "  \n ", "one", "Two WORDS", "two words", "tab\tand\x0bline\nends\r\n", "a " * 150, "長い 文 " * 60, " ".join(vocabulary * 4), "I'm  it's\n\n x　y "]
    rows = [(i, t, "clash", 1, "x") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id here at all", "c", 1, "x"), (5, "same id, other text", "c", 1, "x")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def cut(units, length):
    """For each sequence, which of its units lie in a run of `length` that starts more than once."""
    seen = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_repeated_words(docs, rows, nothing):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    want = Counter()
    for (i, *_), w, g in zip(rows, words, cut(words, 35), strict=True):
        kept = b" ".join(x for x, gone in zip(w, g, strict=True) if not gone)
        want[i, len(w), sum(g), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.repeated_words(docs, width=16)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert sum(k[2] for k in want) > 0
    # a sketch so small that it lets everything through changes nothing
    tight = substring_dedup.repeated_words(docs, width=7)
    assert Counter(tuple(r) for r in tight.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert substring_dedup.repeated_words(nothing, width=16).count() == 0


@pytest.mark.parametrize("most_kinds", [8192, 1])
def test_repeated_bytes(docs, rows, nothing, most_kinds):
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = Counter()
    for (i, *_), t, g in zip(rows, texts, cut(texts, 200), strict=True):
        kept = bytes(x for x, gone in zip(t, g, strict=True) if not gone)
        spans = sum(b and not a for a, b in zip([False, *g], g, strict=False))
        want[i, len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.repeated_bytes(docs, width=16, most_kinds=most_kinds)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
    if most_kinds == 1:
        assert suffix_dedup.repeated_bytes(nothing, width=16).count() == 0


def test_without_repeats_keeps_rows_and_columns(docs, rows):
    out = suffix_dedup.without_repeats(docs, width=16)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_index_matches_brute_force():
    r = random.Random(1)
    base = bytes(r.choice(b"ab") for _ in range(300))
    texts = [base[:200], base[50:260], bytes(r.choice(b"abc") for _ in range(150)), base[100:], b"a" * 120]
    for got, gone in zip(suffix_dedup.repeated_starts(texts, 40), [None] * len(texts), strict=True):
        assert gone is None and (np.diff(got) > 0).all()
    seen = Counter(t[i : i + 40] for t in texts for i in range(len(t) - 39))
    want = [[i for i in range(len(t) - 39) if seen[t[i : i + 40]] > 1] for t in texts]
    assert [x.tolist() for x in suffix_dedup.repeated_starts(texts, 40)] == want


@pytest.mark.parametrize("letter", [b"a", b"\0"])
def test_index_of_runs_that_tie_beyond_their_ends(letter):
    texts = [letter * n for n in (13, 29, 30, 9)]  # the long ones lie side by side: what follows a run agrees further than any text is long
    assert [x.tolist() for x in suffix_dedup.repeated_starts(texts, 20)] == [[], list(range(10)), list(range(11)), []]


def sets_of(rows, n):
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        yield i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


@pytest.mark.parametrize(("n", "block"), [(2, 1024), (5, 2)])
def test_near_duplicates(docs, rows, nothing, n, block):
    sets = list(sets_of(rows, n))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    want = Counter()
    for a, (i, x) in enumerate(sets):
        c = least.get(find(a)) if x else i
        want[i, len(x), c, c is None or i == c] += 1
    got = near_dedup.near_duplicates(docs, words=n, block=block).drop("rk")
    assert Counter(tuple(r) for r in got.collect()) == want
    if block > 2:
        assert near_dedup.near_duplicates(nothing).count() == 0


def test_large_group_in_blocks(spark):
    r = random.Random(3)
    base = [f"v{r.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(6):
            w[r.randrange(300)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8)
    assert {r["component_id"] for r in got.collect()} == {0}


def star(members=300, words=300, changed=20, seed=5):
    """A text and copies that each differ from it in their own places: about 0.87 to it, 0.77 to each other."""
    r = random.Random(seed)
    base = [f"v{i}" for i in range(words)]
    texts = [" ".join(base)]
    for i in range(members):
        w = list(base)
        for at in r.sample(range(words), changed):
            w[at] = f"n{i}x{at}"
        texts.append(" ".join(w))
    return texts


def joined(n, pairs):
    """The least member that links reach, of each of n."""
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_pairs_join_what_the_window_holds():
    r = np.random.default_rng(1)
    for agree in (64, 40, 33, 31):
        sketch = np.tile(r.integers(0, 256, 64, dtype=np.uint8), (60, 1))
        for i in range(60):
            sketch[i, r.choice(64, (64 - agree) // 2 + 1, replace=False)] = i
        rows = {"tree": np.zeros(60, int), "key": np.repeat([0, 1], 30), "n": r.integers(240, 330, 60), "c": np.arange(60), "sketch": sketch}
        want = [(a, b) for b in range(60) for a in range(max(0, b - 16), b) if rows["key"][a] == rows["key"][b] and min(rows["n"][[a, b]]) >= 0.8 * max(rows["n"][[a, b]]) and (sketch[a] == sketch[b]).sum() >= near_dedup.MAYBE]
        got = near_dedup._pairs(rows, 16, 0, 0.8)
        got = list(zip(got["a"].tolist(), got["b"].tolist(), strict=True))
        assert set(got) <= set(want) and joined(60, got) == joined(60, want)


def test_components_of_the_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = dict(sets_of(rows, 2))
    holds, pairs = {}, Counter()
    for d, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(d)
    for ds in holds.values():
        pairs.update((a, b) for i, b in enumerate(ds) for a in ds[:i])
    want = {d: d for d in sets}
    linked = [p for p in pairs if 100 * len(sets[p[0]] & sets[p[1]]) >= 80 * len(sets[p[0]] | sets[p[1]])]
    for _ in range(50):
        for a, b in linked:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want


def test_unlike_documents_with_common_passages_form_no_group(spark, monkeypatch):
    """Half of each document is the same in all; one in ten is an edited copy of the one before, and some are beyond 0.8."""
    r = random.Random(5)
    common = [f"b{i}" for i in range(61)]
    rows = []
    for i in range(1500):
        own = [f"w{r.randrange(10**9)}" for _ in range(60)]
        if i % 10 == 9:
            own = [x if r.random() > 0.05 else f"z{r.randrange(10**9)}" for x in rows[-1][1].split(" ")[61:]]
        rows.append((i, " ".join(common + own)))
    sets = dict(sets_of(rows, 2))
    want = {i: i - 1 if i % 10 == 9 and 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1]) else i for i in sets}
    seen = []
    rare = near_dedup.by_rare_shingles
    monkeypatch.setattr(near_dedup, "by_rare_shingles", lambda docs, some, *a: seen.append(some.count()) or rare(docs, some, *a))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), lags=1)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert seen[0] > 100 and 0 < sum(k != v for k, v in want.items()) < 150


def test_rare_shingles_find_what_the_forest_does_not(spark):
    """The exact way alone, in small blocks, finds every linked pair."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        base = [f"v{r.randrange(40)}" for _ in range(80)] if i % 3 == 0 else rows[i - 1][1].split(" ")
        rows.append((i, " ".join(x if r.random() > 0.03 else f"n{r.randrange(10**6)}" for x in base)))
    sets = dict(sets_of(rows, 2))
    linked = {(a, b) for b in sets for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = shared.Tables(spark, "test")
    signed = tables.save(near_dedup._documents(shared.keyed_documents(docs), 2, 20, 4))
    some = signed.selectExpr("hi", "lo", "doc_id c", "doc_id g", "n", "substring(sig, 321, 64) sketch")
    for often, block in ((32, 4096), (3, 2)):
        got = {(p["a"], p["b"]) for p in near_dedup.by_rare_shingles(docs, some, 2, 80, tables, often, block).collect()}
        assert linked and linked <= got
    folder = tables.folder
    tables.close()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)) == 0


def test_group_larger_than_the_window_is_whole(spark):
    frame = spark.createDataFrame(list(enumerate(star())), "doc_id long, text string")
    for block in (1024, 64):
        got = near_dedup.near_duplicates(frame, words=1, block=block)
        assert {r["component_id"] for r in got.collect()} == {0}


def test_contained(spark, docs, rows, nothing):
    long = (rows[8][1]).split(" ")
    items = [(0, " ".join(long[2:30])), (1, "never seen anywhere at all in it"), (2, None), (3, "One"), (4, ""), (0, "two words"), (5, " ".join(long[5:8])), (6, " ".join(long[5:9:2]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t in items:
        n = min(5, len((t or "").split()))
        ((_, y),) = sets_of([(i, t)], 5)
        want.update((d, i, len(y), len(x & y)) for d, x in sets_of(rows, n) if y and 10 * len(x & y) >= 8 * len(y))
    assert any(i == 5 for _, i, *_ in want)
    for slice_ in (1 << 20, 3):
        got = decontaminate.contained(docs, frame, most_shingles=slice_)
        assert Counter(tuple(r)[:4] for r in got.collect()) == want
    assert len(want) >= 3
    hit = {d for d, *_ in want}
    assert {r["doc_id"] for r in decontaminate.clean(docs, frame).collect()}.isdisjoint({0} & hit)
    assert decontaminate.clean(docs, frame).columns == docs.columns
    assert decontaminate.contained(nothing, frame).count() == 0 and decontaminate.contained(docs, frame.limit(0)).count() == 0


def brute_ppm(texts, order):
    counts: dict[bytes, Counter] = {}
    for x in texts:
        b = b"\xff" * order + x + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault(b[i - k : i], Counter())[b[i]] += 1

    def score(x):
        b, total = b"\xff" * order + x + b"\xff", 0.0
        for i in range(order, len(b)):
            out: set[int] = set()
            for k in range(order, -1, -1):
                seen = counts.get(b[i - k : i], Counter())
                live = {a: n for a, n in seen.items() if a not in out}
                whole = sum(live.values()) + len(live)
                if b[i] in live:
                    total += math.log10(live[b[i]] / whole)
                    break
                if live:
                    total += math.log10(len(live) / whole)
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total

    return score


def test_ppm(docs, rows, nothing):
    got = ppm.score(docs, order=3, most_frequent=20).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    texts = [(t or "").encode().lower() for _, t, *_ in rows]
    training = [t for t, h in zip(texts, held, strict=True) if not h]
    c = Counter(w for t in training for w in [*t.split(), None])
    n, v, model = sum(c.values()), len(c), brute_ppm(training, 3)
    want = Counter()
    for (i, *_), t, h in zip(rows, texts, held, strict=True):
        w = [*t.split(), None]
        want[i, h, len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), round(model(t), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert ppm.score(nothing, order=2).count() == 0


def test_ppm_bound_of_nodes_changes_nothing(docs, rows):
    model = brute_ppm([(t or "").encode().lower() for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2], 5)
    want = Counter((i, round(model((t or "").encode().lower()), 6)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in ppm.score(docs, most_nodes=200).collect()) == want


def test_ppm_cuts_long_texts_alike():
    text = ("ab" * 300_000).encode()
    whole = sum(len(codes) for codes, _, _ in ppm.pieces([text], 3))
    assert whole == len(text) + 1


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    return byte_bpe.ByteBPE(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def test_byte_bpe(docs, rows, nothing, bpe):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    want = Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    got = bpe.encode_documents(docs, chunk_bytes=700).collect()
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode_documents(nothing).count() == 0


def test_byte_bpe_of_very_long_words(spark, bpe):
    """Words beyond the fold: equal to the library's, within seconds for 100,000 letters."""
    import tiktoken

    r = random.Random(8)
    texts = ["".join(r.choice("abethinrsé") for _ in range(n)) for n in (300, 511, 512, 513, 3000, 100_000)] + ["a" * 2000, "=" * 5000 + " x"]
    library = tiktoken.Encoding("own", pat_str=bpe.pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    got = {x.doc_id: x for x in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t) and got[i].decoded.decode() == t


def test_byte_bpe_columns(spark, bpe):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = ["", "Hello  world\n\n it's\u00a0x ", "aaaaaaaaaaaaaaaaaaaaa", "naïve 日本 12345 !!!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", bpe.ids(F.col("text")).alias("ids"))
    for r in df.withColumn("back", bpe.bytes_of(F.col("ids"))).collect():
        assert list(r["ids"]) == enc.encode_ordinary(r["text"]) and bytes(r["back"]).decode() == r["text"]


def test_units_join_and_are_independent(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(5)
    signs = [" ", " ", "\n", "\t", "a", "B", "7", "!", "'s", "é", "\u3000", "\x1c"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["", " ", " a", "a ", "  "]
    units, codes, ends = byte_bpe.split_units(pa.array(texts))
    assert len(ends) == len(texts)
    for t, a, z in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False):
        u = [units[c] for c in codes[a:z]]
        assert "".join(u) == t and [i for x in u for i in enc.encode_ordinary(x)] == enc.encode_ordinary(t)
        assert [w for x in u for w in bpe.words.findall(x)] == bpe.words.findall(t)


def test_severity(spark, docs, nothing):
    r = random.Random(2)
    plain, bad = [f"p{i}q" for i in range(200)], ["grumble", "snarlish", "vexoid"]
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    plain = ["".join(r.choice(alphabet) for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(400):
        w = [r.choice(plain) for _ in range(r.randint(10, 60))]
        for _ in range((i % 4 == 0) * r.randint(1, 8)):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_on(frame.select("doc_id", "text"), frame.filter("doc_id < 200").select("doc_id", "toxic"))
    assert list(model.thresholds) == sorted(model.thresholds)
    held = toxicity.severity(frame, model).join(frame.select("doc_id", F.col("toxic").alias("label")), "doc_id").filter("doc_id >= 200").collect()
    assert sum(r["toxic"] == bool(r["label"]) for r in held) / len(held) > 0.95
    assert all(abs(r["severity"]) <= 2 and (r["severity"] >= r["p_toxic"] - 1e-9) for r in held)
    assert toxicity.severity(docs, model).count() == docs.count() and toxicity.severity(nothing, model).count() == 0
    assert not toxicity.fit(["a b", "c"], [0, 0]).weights and toxicity.severity(docs, toxicity.fit([], [])).filter("toxic").count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_own_columns_stay_whatever_their_names(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "a", 1, 2, "x"), (2, long + " end", "b", 3, 4, "y"), (None, None, "c", 5, 6, "z"), (3, "", "d", 7, 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _id long, _rk long, _found string")
    kept = near_dedup.one_of_each(docs, words=5)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[0], rows[2], rows[3]}
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    assert {(r["doc_id"], r["_key"], r["_id"], r["_rk"], r["_found"]) for r in cut.collect()} == {(r[0], *r[2:]) for r in rows}
