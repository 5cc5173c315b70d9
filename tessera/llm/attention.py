"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is measured (classes
of bytes, word lengths, repetition inside the passage and across the
document), encoded by a small layer, and weighted by gated attention that is
learned from document labels alone; the classifier scores the weighted
representation.  Fitting takes a bounded sample of labelled documents; scoring
reads every passage of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .samples import TRAIN_BYTES, labelled

PASSAGE_WORDS, TRAIN_DOCS, SEED = 64, 4000, 11
HIDDEN, GATE, EPOCHS, RATE, DECAY = 16, 8, 250, 0.03, 1e-3
THRESHOLD = 0.3

#: Classes of bytes whose shares describe a passage; the last is everything else.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "$%&*#", "\"'", "+-=/@_:;()<>[]{}", None]
_CLASS = np.full(256, len(CLASSES) - 1, dtype=np.int64)
for _i, _chars in enumerate(CLASSES[:-1]):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = len(CLASSES)
FEATURES = len(CLASSES) + 1 + 6


def measure(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the first passage of each row (with an end mark); an empty row has one, all zero."""
    starts, ends = tk.spans(~tk.SPACE[raw], offsets)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    begin = np.r_[0, np.cumsum(passages)]
    rows = np.repeat(np.arange(len(words)), words)
    of_word = begin[rows] + (np.arange(len(starts)) - first[rows]) // PASSAGE_WORDS if len(starts) else np.zeros(0, np.int64)
    n = int(begin[-1])
    out = np.zeros((n, FEATURES))
    # Bytes go with the passage of the last word that began before them.
    head = np.full(n, -1, dtype=np.int64)
    head[begin[:-1]] = offsets[:-1]
    if len(starts):
        lead = np.flatnonzero(np.r_[True, of_word[1:] != of_word[:-1]])
        inner = head[of_word[lead]] < 0
        head[of_word[lead][inner]] = starts[lead][inner]
    size = np.diff(np.r_[head, len(raw)])
    kinds = np.bincount(np.repeat(np.arange(n), size) * (len(CLASSES) + 1) + _CLASS[raw], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
    out[:, : len(CLASSES) + 1] = kinds / np.maximum(size, 1)[:, None]
    if len(starts):
        hashed = tk.hashes(tk.LOWER[raw], starts, ends)
        count = np.maximum(np.bincount(of_word, minlength=n), 1)
        same = np.zeros(len(starts), dtype=bool)
        same[1:] = (hashed[1:] == hashed[:-1]) & (rows[1:] == rows[:-1])
        pair = hashed.copy()
        pair[:-1] += tk.mix(hashed[1:])
        pair[:-2] += tk.mix(tk.mix(hashed[2:]))
        repeats = lambda keys, group: _repeated(keys, group)
        k = len(CLASSES) + 1
        out[:, k] = np.bincount(of_word, weights=np.minimum(ends - starts, 30), minlength=n) / count / 10
        out[:, k + 1] = np.bincount(of_word, weights=same, minlength=n) / count
        out[:, k + 2] = np.bincount(of_word, weights=repeats(hashed, of_word), minlength=n) / count
        out[:, k + 3] = np.bincount(of_word, weights=repeats(pair, rows), minlength=n) / count
        out[:, k + 4] = np.bincount(of_word, weights=ends - starts > 20, minlength=n) / count
    out[:, -1] = np.log1p(np.repeat(words, passages)) / 10
    return out, begin


def _repeated(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a key stands more than once in its group."""
    mixed = tk.mix(keys + tk.mix(group.astype(np.uint64)))
    order = np.argsort(mixed)
    s = mixed[order]
    twice = np.zeros(len(s), dtype=bool)
    equal = s[1:] == s[:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    out = np.empty(len(s), dtype=bool)
    out[order] = twice
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return _forward((x - self.mean) / self.spread, begin, self.weights)["p"]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _forward(x: np.ndarray, begin: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    first, size = begin[:-1], np.diff(begin)
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    raw = (t * g) @ w["attend"]
    e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), size))
    a = e / np.repeat(np.add.reduceat(e, first), size)
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out0"])}


def gradient(x: np.ndarray, begin: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the documents ``x[begin[i]:begin[i+1]]`` with labels ``y``, by weight."""
    size, f = np.diff(begin), _forward(x, begin, w)
    ds = (f["p"] - y) / len(y)
    dz = np.repeat(ds[:, None] * w["out"], size, axis=0)
    da = (f["h"] * dz).sum(axis=1)
    draw = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begin[:-1]), size))
    dtg = draw[:, None] * w["attend"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
    return {"encode": x.T @ dh, "encode0": dh.sum(axis=0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": (f["t"] * f["g"]).T @ draw, "out": f["z"].T @ ds, "out0": ds.sum()}


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Full-batch gradient descent (Adam) on documents ``x[begin[i]:begin[i+1]]`` with labels 0 or 1."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    rng = np.random.default_rng(seed)
    shape = {"encode": (x.shape[1], HIDDEN), "encode0": (HIDDEN,), "tanh": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,), "out0": ()}
    w = {k: rng.standard_normal(s) / np.sqrt(max(1, s[0] if s else 1)) if not k.endswith("0") else np.zeros(s) for k, s in shape.items()}
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        grad = gradient(x, begin, y, w)
        for k in w:
            d = grad[k] + (0 if k.endswith("0") else DECAY * w[k] / len(y) * 10)
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, spread, w)


def _measured(batches):
    for batch in batches:
        for a, b, raw, offsets in tk.slices(batch.column("text")):
            x, begin = measure(raw, offsets)
            x = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("y").slice(a, b - a), pa.array([x[begin[i] : begin[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                names=["y", "x"],
            )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", limit: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Model | None:
    """Fit on up to ``limit`` documents of at most ``max_bytes`` bytes with label 0 or 1; None without two classes."""
    rows = labelled(docs, labels.select(key, label), F.col(label).isin(0, 1), limit, key, text, max_bytes)
    got = rows.select(F.col(text).alias("text"), F.col(label).cast("double").alias("y")).mapInArrow(_measured, "y double, x binary").collect()
    got.sort(key=lambda r: (r.x, r.y))
    y = np.array([r.y for r in got])
    if len(np.unique(y)) < 2:
        return None
    bags = [np.frombuffer(r.x, dtype=np.float32).reshape(-1, FEATURES) for r in got]
    return fit(np.concatenate(bags).astype(np.float64), np.r_[0, np.cumsum([len(b) for b in bags])], y)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, score, predicted, n_passages`` of each row.

    Null and empty texts are a bag of one empty passage.  Repeated rows score alike.  Without a model (no labels of
    both classes) every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in tk.slices(batch.column("text")):
                x, begin = measure(raw, offsets)
                score = shared.value.score(x, begin) if shared.value else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.diff(begin))], names=["key", "score", "predicted", "n_passages"]
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double, predicted int, n_passages long").withColumnRenamed("key", key)
