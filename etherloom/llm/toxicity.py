"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; a later model has the probabilities of the earlier categories as
features. Those are out-of-fold when it is trained, each from a model that has not seen the row, so the chain learns
from probabilities as good as it will get. The models are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordKeys, map_rows

SAMPLE = 12_000  #: labelled documents to fit on, expected number
FOLDS = 3
LEAST_DOCS = 5  #: documents of the sample that must have a feature
EVIDENCE = 4.0  #: standard errors between a feature's rates in the two classes
ROUNDS, RIDGE = 150, 1e-3
_TOKENS = re.compile(r"\w+|[^\w\s]{2,}").findall


def features(text: str | None) -> set[str]:
    """Distinct words and runs of symbols, in lower case."""
    return set(_TOKENS((text or "").lower()))


class Linear:
    """Logistic model over the presence of some features and over dense columns."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.keys, self.weights, self.dense, self.bias = keys, weights, dense, bias

    @staticmethod
    def train(rows: np.ndarray, keys: np.ndarray, n: int, dense: np.ndarray, y: np.ndarray) -> Linear:
        """rows, keys: (row, feature key) of what each of the n rows has; dense: n x d."""
        pos = max(1e-9, float(y.sum()))
        neg = max(1e-9, n - float(y.sum()))
        known, col = np.unique(keys, return_inverse=True)
        df = np.bincount(col, minlength=len(known))
        in_pos = np.bincount(col, weights=y[rows], minlength=len(known))
        a, b, p = in_pos / pos, (df - in_pos) / neg, df / max(n, 1)
        z = np.abs(a - b) / np.sqrt(np.maximum(p * (1 - p) * (1 / pos + 1 / neg), 1e-12))
        keep = (df >= LEAST_DOCS) & (z >= EVIDENCE)
        new = np.cumsum(keep) - 1
        used = keep[col]
        rows, col, d = rows[used], new[col[used]], dense.shape[1]
        k = int(keep.sum())
        w, bias = np.zeros(k + d), float(np.log(pos / neg))
        move, move_bias = np.zeros(k + d), 0.0
        for _ in range(ROUNDS):  # full gradients with steps by their running size
            out = bias + np.bincount(rows, weights=w[col], minlength=n) + dense @ w[k:]
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / max(n, 1)
            g = np.r_[np.bincount(col, weights=error[rows], minlength=k)[:k], error @ dense] + RIDGE * w / 10
            move += g * g
            move_bias += float(error.sum()) ** 2
            w -= 0.5 * g / np.sqrt(move + 1e-12)
            bias -= 0.5 * float(error.sum()) / np.sqrt(move_bias + 1e-12)
        return Linear(known[keep], w[:k], w[k:], bias)

    def predict(self, rows: np.ndarray, keys: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at = np.minimum(at, max(0, len(self.keys) - 1))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = self.bias + np.bincount(rows[hit], weights=self.weights[at[hit]] if hit.any() else None, minlength=n)[:n]
        return 1 / (1 + np.exp(-np.clip(out + dense @ self.dense, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold with the best F1 on out-of-fold probabilities; 1 if nothing is positive."""
    if not y.sum():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0  # equal probabilities stand on one side
    at = int(f1.argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> dict:
    """Models in the order of ``categories`` (name -> 0/1 column of ``labels``) and the threshold of each.

    About ``sample`` labelled ids are taken by a hash; only their documents' feature hashes come to the driver.
    Labels with a null in a category, and labels without a document, are left out.
    """
    rows = labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    rows = rows.dropDuplicates(["doc_id"])
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # the sample has a bound, whatever the table: it goes to the scan of the documents
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    names = list(categories)

    def make():
        keys = WordKeys()

        def work(batch):
            found = [keys.array(sorted(features(t))).view(np.int64) for t in batch["text"].to_pylist()]
            yield {"doc_id": batch["doc_id"], "keys": found} | {c: batch[c] for c in names}

        return work

    schema = "doc_id bigint, keys array<bigint>, " + ", ".join(f"`{c}` int" for c in names)
    data = map_rows(chosen, schema, make).toArrow().sort_by("doc_id")
    n = data.num_rows
    sizes = [len(x) for x in data["keys"]]
    rows_of = np.repeat(np.arange(n), sizes)
    keys = data["keys"].combine_chunks().flatten().to_numpy() if n else np.empty(0, np.int64)
    fold = np.arange(n) % FOLDS
    dense, models, thresholds = np.zeros((n, 0)), [], []
    for c in names:
        y = data[c].to_numpy().astype(float) if n else np.zeros(0)
        apart = np.zeros(n)
        for k in range(FOLDS):
            for part, learn in ((fold != k, True), (fold == k, False)):
                at = np.flatnonzero(part)
                place = np.full(n, -1)
                place[at] = np.arange(len(at))
                own = place[rows_of] >= 0
                args = (place[rows_of][own], keys[own], len(at), dense[at])
                if learn:
                    model = Linear.train(*args, y[at])
                else:
                    apart[at] = model.predict(*args)
        models.append(Linear.train(rows_of, keys, n, dense, y))
        thresholds.append(best_threshold(apart, y))
        dense = np.c_[dense, np.log(apart + 1e-6) - np.log(1 - apart + 1e-6)] if n else np.zeros((0, dense.shape[1] + 1))
    return {"names": names, "models": models, "thresholds": thresholds}


def score_chain(docs: DataFrame, chain: dict) -> DataFrame:
    """``doc_id``, ``p_<category>`` of each category and ``<category>`` (boolean) of the last, for each input row.

    A null or empty text has no features and gets what the models say of none. With no labelled row of a category
    its probability is close to nothing and its verdict false.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain["names"]

    def make():
        models, limit = shared.value["models"], shared.value["thresholds"][-1]
        weight: dict[int, np.ndarray] = {}
        for k, m in enumerate(models):
            for key, w in zip(m.keys.tolist(), m.weights.tolist(), strict=True):
                weight.setdefault(key, np.zeros(len(models)))[k] = w
        hashes = WordKeys()
        found: dict[str, np.ndarray | None] = {}

        def of(word):
            if len(found) >= hashes.limit:
                found.clear()
            key = hashes[word]
            found[word] = w = weight.get(key - (1 << 64) if key >> 63 else key)
            return w

        def work(batch):
            out = []
            for t in batch["text"].to_pylist():
                has = [w for x in features(t) if (w := found[x] if x in found else of(x)) is not None]
                sums, ps, logits = np.sum(has, axis=0) if has else np.zeros(len(models)), [], []
                for k, m in enumerate(models):
                    z = min(30.0, max(-30.0, sums[k] + m.bias + sum(a * b for a, b in zip(m.dense, logits))))
                    ps.append(float(1 / (1 + np.exp(-z))))
                    logits.append(float(np.log(ps[-1] + 1e-6) - np.log(1 - ps[-1] + 1e-6)))
                out.append(ps)
            columns = {f"p_{c}": [p[k] for p in out] for k, c in enumerate(names)}
            yield {"doc_id": batch["doc_id"]} | columns | {names[-1]: [p[-1] > limit for p in out]}

        return work

    schema = "doc_id bigint, " + ", ".join(f"`p_{c}` double" for c in names) + f", `{names[-1]}` boolean"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The chain low quality -> toxic, fitted on ``labels`` and applied to all ``docs``: ``doc_id, p_low_quality, p_toxic, toxic``."""
    chain = fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return score_chain(docs, chain)
