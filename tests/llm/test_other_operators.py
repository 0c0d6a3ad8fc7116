"""Nearest neighbours, URL filters, chat rotation, components and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, components, permutation_index, urls


def test_permutation_index(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64)).round(3)
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    rows += [(2000 + k, rows[7][1], "copy") for k in range(30)] + [(5000, None, ""), (5001, [0.0] * 64, ""), (5002, [float("nan")] * 64, ""), (5003, [1.0], ""), (None, rows[3][1], ""), rows[9], (5050, [None] * 64, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, hi string").repartition(3)
    got = permutation_index.PermutationIndex().search(df, F.col("vec_id") % 50 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.concatenate([np.arange(1500), 2000 + np.arange(30)])
    all_ = np.concatenate([unit, np.repeat(unit[7:8], 30, 0)])
    found = total = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    queries = [i for i in ids.tolist() if i % 50 == 0]
    assert sorted(by) == sorted(queries)
    for q in queries:
        s = all_ @ all_[ids.tolist().index(q)]
        s[ids == q] = -9
        want = {int(ids[i]) for i in np.lexsort((ids, -s.round(12)))[:5]}
        own = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(a["score"] >= b["score"] for a, b in zip(own, own[1:], strict=False))
        found += len(want & {r["vec_id"] for r in own})
        total += 5
    assert found / total >= 0.9
    assert [r["vec_id"] for r in sorted(by[2000], key=lambda r: r["rank"])] == [7, 2001, 2002, 2003, 2004]
    empty = permutation_index.PermutationIndex().search(df.limit(0), F.col("vec_id") % 50 == 0)
    assert empty.count() == 0


def test_url_rules(spark):
    cases = {
        "http://a.EXAMPLE.com/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://example.com/en/8#f": ("example.com", "/en/8", "com/en/", "block"),
        "x://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://telecom/en/1": ("telecom", "/en/1", None, "allow"),
        "http://s.example.net/de/81": ("s.example.net", "/de/81", "example.net/de/8", "block"),
        "http://w.net/de/1": ("w.net", "/de/1", "net/de/", "allow"),
        "http://o.org/es/1": ("o.org", "/es/1", "org/es/", "block"),
        "http://h?x/en/": ("h", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(i, u, None, "h") for i, u in enumerate(cases)] + [(0, next(iter(cases)), None, "h")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        u = rows[r["page_id"]][1]
        if u != "http://o.org/es/1":
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[u]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_trust_spreads(spark):
    link = '<a href="http://{0}/x">l</a> <img src=//{0}/i.png>'
    rows = [
        (1, "http://good.net/de/1", link.format("mid.xx") + '<a HREF=\'https://MID.xx:80\'>'), (2, "http://mid.xx/1", link.format("leaf.xx")), (3, "http://leaf.xx/1", ""),
        (4, "http://bad.org/es/1", ""), (5, "http://shill.xx/1", link.format("bad.org")), (6, "http://far.xx/1", link.format("shill.xx")), (7, "http://lone.xx/1", '<a href="/in">x</a>'),
    ]
    got = {r["host"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == {"good.net": "allow", "mid.xx": "allow", "leaf.xx": "allow", "bad.org": "block", "shill.xx": "block", "far.xx": "block", "lone.xx": "allow"}
    assert got["mid.xx"]["trust"] > got["leaf.xx"]["trust"] > 0 and got["shill.xx"]["distrust"] > got["far.xx"]["distrust"] > 0


def test_mass_against_brute_force(spark):
    r = random.Random(2)
    hosts = [f"h{i}" for i in range(60)]
    edges = {(a, b): r.randint(1, 4) for a in hosts for b in ["h0", *r.sample(hosts, r.randint(0, 3))] if a != b}
    edges |= {(f"h{i}", f"h{i + 1}"): 1 for i in range(60, 100)}  # a long chain
    out = Counter()
    for (a, _), w in edges.items():
        out[a] += w
    share = [(a, b, w / out[a]) for (a, b), w in edges.items()]
    seeds = {"h3": 0.25, "h7": 0.25, "h60": 0.5}
    want = Counter()
    now = Counter({h: m * 0.15 for h, m in seeds.items()})
    for _ in range(400):  # each round moves what the former has brought
        want.update(now)
        after = Counter()
        for a, b, x in share:
            after[b] += now[a] * x * 0.85
        now = after
    got = urls.spread(spark.createDataFrame(share, "src string, dst string, share double"), spark.createDataFrame(list(seeds.items()), "host string, mass double"), 0.85, 1e-9)
    got = {r["host"]: r["mass"] for r in got.collect()}
    assert sum(abs(got.get(h, 0.0) - m) for h, m in want.items()) < 1e-8 and got.keys() <= want.keys() and got["h100"] > 0


def test_distrust_reaches_far_hosts(spark):
    rows = [(0, "http://bad.org/es/1", "")] + [(i, f"http://n{i}.xx/", f'<a href="http://{"bad.org" if i == 1 else f"n{i - 1}.xx"}/">') for i in range(1, 21)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["verdict"] for r in got} == {"block"}


def test_rotations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 300, "ann", "späte"), (1, 1, "user", "hi"), (2, 0, "system", "alone"), (None, None, None, None), (3, 5, "user", "")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "conv_id long, turn long, role string, text string, parts string")
    got = {(r["conv_id"], r["participant"], r["block"]): r for r in chat.rotations(df).collect()}
    assert sorted(k for k in got if k[0] == 1) == sorted((1, p, b) for p in ("user", "assistant", "ann") for b in (0, 1))
    r = got[1, "user", 0]
    assert r["text"] == "<|im_start|>system\nbe kind<|im_end|>\n" + "<|im_start|>assistant\nhi<|im_end|>\n" * 2 + "<|im_start|>user name=assistant\nhello<|im_end|>\n"
    assert (r["mask"], r["n_turns"], r["n_trained"]) == ("0110", 4, 2) and [r["text"][s["start"] : s["stop"]] for s in r["spans"]] == ["hi", "hi"]
    late = got[1, "ann", 1]
    assert [late["text"][s["start"] : s["stop"]] for s in late["spans"]] == ["späte"]
    assert got[None, "unknown", -1]["text"] == "<|im_start|>assistant\n<|im_end|>\n" and not any(k[0] == 2 for k in got)
    assert chat.rotations(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1 << 19, 20])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "ROWS", rows)
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)]
    root: dict[int, int] = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = Counter((r["node"], r["label"]) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == Counter((n, find(n)) for n in list(root))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
