"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: each model sees the words of a
text and the probabilities of the categories before it.  In fitting, those
probabilities are out-of-fold predictions, so that later models learn from
inputs as unsure as the ones they will meet.  Words are runs of letters in
lower case, present or not; each category keeps the words that tell most about
it.  Fitting takes a bounded sample of labelled documents; scoring reads every
word of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .samples import TRAIN_BYTES, labelled

TRAIN_DOCS, FOLDS, WORDS, LEAST_DOCS, SEED = 8000, 4, 4096, 3, 5
STEPS, RATE, RIDGE = 150, 0.3, 2.0
#: Categories in the order of the chain: conditions on the label columns.
CATEGORIES = {"toxic": "toxic = 1", "toxic_junk": "toxic = 1 and quality = 0"}


def present(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of each row, and row bounds."""
    starts, ends = tk.spans(tk.LETTER[raw], offsets)
    hashed = tk.hashes(tk.LOWER[raw], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashed, rows))
    hashed, rows = hashed[order], rows[order]
    if len(rows):
        new = np.r_[True, (rows[1:] != rows[:-1]) | (hashed[1:] != hashed[:-1])]
        hashed, rows = hashed[new], rows[new]
    return hashed, np.searchsorted(rows, np.arange(len(first)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values)]
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Linear:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def score(self, hashed: np.ndarray, bounds: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        out = np.full(len(bounds) - 1, self.bias) + earlier @ self.earlier
        if len(self.words) and len(hashed):
            at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
            out += _sums(np.where(self.words[at] == hashed, self.weights[at], 0.0), bounds)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def telling(hashed: np.ndarray, bounds: np.ndarray, y: np.ndarray, most: int = WORDS) -> np.ndarray:
    """The words whose presence tells most about ``y`` (chi-squared), sorted."""
    words, at, n = np.unique(hashed, return_inverse=True, return_counts=True)
    hits = np.bincount(at, weights=np.repeat(y, np.diff(bounds)), minlength=len(words))
    share = y.mean()
    chi = (hits - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-12)
    chi[n < LEAST_DOCS] = 0
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(words[best[chi[best] > 4.0]])


def fit_one(hashed: np.ndarray, bounds: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge logistic regression on the telling words and the earlier probabilities."""
    if not len(y):
        return Linear(hashed[:0], np.zeros(0), np.zeros(earlier.shape[1]), -4.0)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    words = telling(hashed, bounds, y)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(len(words)), np.zeros(earlier.shape[1])
    rows = np.repeat(np.arange(len(y)), np.diff(bounds))
    at = np.minimum(np.searchsorted(words, hashed), max(len(words) - 1, 0))
    keep = words[at] == hashed if len(words) else np.zeros(len(hashed), bool)
    at, rows = at[keep], rows[keep]
    m = [np.zeros_like(w), np.zeros_like(v), 0.0]
    s = [np.zeros_like(w), np.zeros_like(v), 0.0]
    for step in range(1, STEPS + 1):
        z = bias + earlier @ v + np.bincount(rows, weights=w[at], minlength=len(y))
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grads = [np.bincount(at, weights=g[rows], minlength=len(w)) + RIDGE * w, earlier.T @ g + RIDGE * v, g.sum()]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.99 * s[i] + 0.01 * d * d
            move = RATE / np.sqrt(step) * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
            if i == 0:
                w = w - move
            elif i == 1:
                v = v - move
            else:
                bias = float(bias - move)
    return Linear(words, w, v, bias)


def _take(hashed: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [hashed[bounds[i] : bounds[i + 1]] for i in rows]
    return np.concatenate(parts) if parts else hashed[:0], np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    thresholds: list[float]

    def score(self, hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probabilities [row, category]."""
        out = np.zeros((len(bounds) - 1, 0))
        for model in self.models:
            out = np.column_stack([out, model.score(hashed, bounds, out)])
        return out


def fit(hashed: np.ndarray, bounds: np.ndarray, targets: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """Fit the chain; each category's threshold gives the best F1 out of fold."""
    n = len(bounds) - 1
    fold = np.random.default_rng(SEED).permutation(n) % folds
    out_of_fold = np.zeros((n, 0))
    chain = Chain([], [], [])
    for name, y in targets.items():
        p = np.zeros(n)
        for k in range(folds):
            mine, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            model = fit_one(*_take(hashed, bounds, rest), out_of_fold[rest], y[rest])
            p[mine] = model.score(*_take(hashed, bounds, mine), out_of_fold[mine])
        chain.models.append(fit_one(hashed, bounds, out_of_fold, y))
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, n + 1) + max(y.sum(), 1))
        best = int(np.argmax(f1)) if n else 0
        above, below = (p[order[best]], p[order[min(best + 1, n - 1)]]) if n else (0.5, 0.5)
        chain.names.append(name)
        chain.thresholds.append(float((above + below) / 2))
        out_of_fold = np.column_stack([out_of_fold, p])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Chain:
    """Fit on up to ``limit`` documents of at most ``max_bytes`` bytes that have a label for each category."""
    categories = categories or CATEGORIES
    marks = labels.select(key, *(F.expr(f"cast({c} as double)").alias(f"__y{i}") for i, c in enumerate(categories.values())))
    names = [f"__y{i}" for i in range(len(categories))]
    wanted = F.lit(True)
    for c in names:
        wanted = wanted & F.col(c).isNotNull()

    def words(batches):
        for batch in batches:
            for a, b, raw, offsets in tk.slices(batch.column("text")):
                hashed, bounds = present(raw, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashed[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)], pa.binary()), *(batch.column(c).slice(a, b - a) for c in names)], names=["words", *names]
                )

    rows = labelled(docs, marks, wanted, limit, key, text, max_bytes).select(F.col(text).alias("text"), *names)
    got = sorted(rows.mapInArrow(words, "words binary, " + ", ".join(f"{c} double" for c in names)).collect())
    parts = [np.frombuffer(r[0], dtype=np.uint64) for r in got]
    hashed = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    bounds = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    return fit(hashed, bounds, {k: np.array([r[i + 1] for r in got]) for i, k in enumerate(categories)})


def predict(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, p_<category> ..., is_<category> ...`` of each row.

    Null and empty texts, and texts without known words, get the models' base rates.  Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b, raw, offsets in tk.slices(batch.column("text")):
                p = model.score(*present(raw, offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), *(pa.array(p[:, i]) for i in range(p.shape[1])), *(pa.array(p[:, i] >= t) for i, t in enumerate(model.thresholds))],
                    names=["key", *(f"p_{x}" for x in model.names), *(f"is_{x}" for x in model.names)],
                )

    kind = docs.schema[key].dataType.simpleString()
    columns = [f"key {kind}", *(f"p_{x} double" for x in chain.names), *(f"is_{x} boolean" for x in chain.names)]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, ", ".join(columns)).withColumnRenamed("key", key)
