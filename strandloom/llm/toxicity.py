"""Toxicity as ordered severity: a cumulative-link model over sparse text features.

P(severity <= k) = 1 / (1 + exp(w.x - t_k)), one weight vector w for all ordered thresholds t_k. Features are
words and the beginnings of words; x is log(1 + count). The model is fitted on a bounded sample of labelled
rows and then applied to every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)


def features_of(token: str) -> list[str]:
    """The words in a token, and their first letters where a word is longer."""
    out = []
    for w in LETTERS.findall(token.lower()):
        out.append(w)
        out += [w[:n] + "*" for n in STEMS if len(w) > n]
    return out


@dataclass(frozen=True)
class SeverityModel:
    """weights by feature; thresholds: between grades 0|1, 1|2, ..., ascending."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def reach(self, counts: dict[str, int]) -> list[float]:
        """P(severity >= k) for k from 1."""
        z = sum(self.weights[f] * math.log1p(n) for f, n in sorted(counts.items()))
        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - z)))) for t in self.thresholds]


def _counts(text: str | None, wanted: dict[str, int]) -> Counter[str]:
    return Counter(f for t in (text or "").split() for f in features_of(t) if f in wanted)


def fit(texts: list[str], toxic: list[int], most_features: int = 2048, grades: int = 2, steps: int = 400) -> SeverityModel:
    """Fits w and the thresholds; severities of toxic texts are equal shares by how much telling they hold.

    A feature is telling if it occurs in at least 3 toxic texts and 2 % of them, and its share of toxic texts is 10 times
    that of clean ones (with one added to the clean count). Without toxic or without clean texts nothing is toxic.
    """
    labels = np.array(toxic, bool)
    none = SeverityModel({}, tuple(20.0 + k for k in range(grades)))
    if labels.all() or not labels.any():
        return none
    n1, n0 = int(labels.sum()), int((~labels).sum())
    support: Counter[str] = Counter()  # of toxic texts first: few features are worth counting anywhere else
    for x, y in zip(texts, labels.tolist(), strict=True):
        if y:
            support.update({f for t in set((x or "").split()) for f in features_of(t)})
    support = {f: k for f, k in support.items() if k >= max(3, 0.02 * n1)}
    bags = [_counts(x, support) for x in texts]
    seen = (Counter(), support)
    for b, y in zip(bags, labels.tolist(), strict=True):
        if not y:
            seen[0].update(b.keys())
    rate = {f: (k / n1) / ((seen[0][f] + 1) / n0) for f, k in support.items()}
    chosen = sorted((f for f, r in rate.items() if r >= 10 or seen[0][f] == 0), key=lambda f: (-rate[f], f))[:most_features]
    if not chosen:
        return none
    at = {f: i for i, f in enumerate(chosen)}
    rows, cols, vals = [], [], []
    for i, b in enumerate(bags):
        for f, k in b.items():
            if f in at:
                rows.append(i)
                cols.append(at[f])
                vals.append(math.log1p(k))
    rows, cols, vals = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals)
    hits = np.bincount(rows, vals, len(bags))
    grade = np.zeros(len(bags), np.int64)
    cuts = np.quantile(hits[labels], [k / grades for k in range(1, grades)]) if grades > 1 else np.zeros(0)
    grade[labels] = 1 + np.searchsorted(cuts, hits[labels], side="right")
    w, first, gaps = np.zeros(len(chosen)), 1.0, np.zeros(grades - 1)
    m, v = np.zeros(len(chosen) + grades), np.zeros(len(chosen) + grades)
    weight = np.where(labels, 0.5 / n1, 0.5 / n0)
    for step in range(1, steps + 1):  # Adam on the penalised likelihood; thresholds are a first one and positive gaps
        t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = np.bincount(rows, w[cols] * vals, len(bags))
        above = np.concatenate([np.ones((len(bags), 1)), 1 / (1 + np.exp(np.clip(t[None] - z[:, None], -60, 60))), np.zeros((len(bags), 1))], 1)
        a, b = above[np.arange(len(bags)), grade], above[np.arange(len(bags)), grade + 1]
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        dz = -(da - db) / p * weight
        dt = np.zeros(grades)
        np.add.at(dt, grade[grade > 0] - 1, (da / p * weight)[grade > 0])
        np.add.at(dt, grade[grade < grades], (-db / p * weight)[grade < grades])
        grad = np.concatenate([np.bincount(cols, dz[rows] * vals, len(chosen)) + 1e-4 * w, [dt.sum()], [dt[k + 1 :].sum() * math.exp(gaps[k]) for k in range(grades - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, first, gaps = w - move[: len(chosen)], first - move[len(chosen)], gaps - move[len(chosen) + 1 :]
    t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return SeverityModel({f: float(w[i]) for f, i in at.items() if w[i] != 0}, tuple(map(float, t)))


def fit_on(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 4000) -> SeverityModel:
    """Fits on at most most_toxic and most_clean labelled rows, those of least hash of the id.

    labels: doc_id, toxic (0 or 1; null and other values are left out).
    """
    ids = None
    for value, most in ((1, most_toxic), (0, most_clean)):
        some = labels.filter(F.col("toxic") == value).select("doc_id", "toxic").dropna().dropDuplicates(["doc_id"])
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.unionByName(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic", "doc_id").toPandas().sort_values("doc_id")
    model = fit(rows["text"].tolist(), rows["toxic"].tolist())
    del rows
    shared.give_back()
    return model


class _Known(dict):
    """Telling features of each token seen."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 1 << 18:
            self.clear()
        self[token] = found = tuple(f for f in features_of(token) if f in self.weights)
        return found


def scorer(model: SeverityModel):
    """text -> P(severity >= k) for k from 1."""
    known, base = _Known(model.weights), model.reach({})

    def score(text: str | None) -> list[float]:
        hits = [f for f in map(known.__getitem__, (text or "").split()) if f]
        return model.reach(Counter(f for h in hits for f in h)) if hits else base

    return score


def severity(docs: DataFrame, model: SeverityModel, reject_from: float = 0.5) -> DataFrame:
    """One row per row of docs (doc_id, text): expected severity, P(severity >= 1) and whether that rejects it.

    Null and empty texts have no features and get the model's base rate. Equal rows are scored each by itself; an empty
    table gives no rows; other columns are ignored.
    Returns doc_id, severity, p_toxic, grade (the likeliest), toxic (p_toxic >= reject_from).
    """
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(model_.value)
        for b in batches:
            reach = [score(t) for t in b["text"].to_pylist()]
            each = [[a - z for a, z in zip([1.0, *r], [*r, 0.0], strict=True)] for r in reach]
            yield {"doc_id": b["doc_id"], "severity": [sum(r) for r in reach], "p_toxic": [r[0] for r in reach], "grade": [e.index(max(e)) for e in each]}

    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    got = shared.stream(docs.select("doc_id", "text"), run, f"doc_id {kind}, severity double, p_toxic double, grade int")
    return got.withColumn("toxic", F.col("p_toxic") >= reject_from)


def without_toxic(docs: DataFrame, model: SeverityModel, reject_from: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that severity() doesn't reject."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    score = None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal score
        score = score or scorer(model_.value)
        return batch.filter(pa.array([score(t)[0] < reject_from for t in batch["text"].to_pylist()], pa.bool_()))

    return shared.rewrite(docs, run)
