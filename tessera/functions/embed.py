"""Embedders: the local subword hash, and a batch connector for remote ones."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION, SHORTEST, LONGEST = 384, 3, 6
#: Prefixes of the two hashes.  Vectors are comparable only under equal prefixes; pass an index's own to query it.
SEEDS = ("tessera-subword-idx-v1::", "tessera-subword-sgn-v1::")
# Words without a vector.
STOPWORDS = set(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do
    does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is
    it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should
    so some such than that the their theirs them themselves then there these they this those through to too under until up very was we
    were what when where which while who whom why with you your yours yourself yourselves""".split()
)
_BASIS, _PRIME, _MASK = 14695981039346656037, 1099511628211, (1 << 64) - 1


def fnv1a(data: bytes, start: int = _BASIS) -> int:
    for b in data:
        start = ((start ^ b) * _PRIME) & _MASK
    return start


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and decimal digits."""
    return re.findall(r"[^\W_]+", "".join(c if c.isalpha() or c.isdecimal() else " " for c in text.lower()))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """FNV-1a of each data[start:end], continued from ``seed``."""
    h = np.full(len(start), seed, dtype=np.uint64)
    for k in range(int((end - start).max(initial=0))):
        on = start + k < end
        h[on] = (h[on] ^ data[start[on] + k]) * np.uint64(_PRIME)
    return h


def _features(words: list[str], dim: int, shortest: int, longest: int, seeds: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells and signs of each word (itself between brackets, and the character n-grams of that), and where each word's begin."""
    bounded = [f"<{w}>" for w in words]
    raw = "".join(bounded).encode()
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    char = np.r_[np.flatnonzero((data & np.uint64(0xC0)) != 0x80), len(data)]  # first byte of each character
    first = np.r_[0, np.cumsum([len(b) for b in bounded])]
    word = np.repeat(np.arange(len(words)), np.diff(first))
    starts, ends, owners = [char[first[:-1]]], [char[first[1:]]], [np.arange(len(words))]
    for n in range(shortest, longest + 1):
        at = np.flatnonzero(np.arange(len(word)) + n <= first[word + 1])
        starts.append(char[at])
        ends.append(char[at + n])
        owners.append(word[at])
    start, end, owner = (np.concatenate(x) for x in (starts, ends, owners))
    order = np.argsort(owner, kind="stable")
    start, end = start[order], end[order]
    index, sign = (_hashes(data, start, end, fnv1a(s.encode())) for s in seeds)
    cells = (index % np.uint64(dim)).astype(np.int64)
    return cells, np.where(sign & np.uint64(1), -1.0, 1.0), np.searchsorted(owner[order], np.arange(len(words) + 1))


def vectors(texts: list[str], dim: int = DIMENSION, shortest: int = SHORTEST, longest: int = LONGEST, seeds: tuple[str, str] = SEEDS) -> list[np.ndarray | None]:
    """Unit mean of each text's word vectors; None without a word that counts."""
    counted = [[t for t in tokens(text or "") if t not in STOPWORDS] for text in texts]
    words = list(dict.fromkeys(t for c in counted for t in c))
    if not words:
        return [None] * len(texts)
    number = {w: i for i, w in enumerate(words)}
    cells, signs, begin = _features(words, dim, shortest, longest, seeds)
    out: list[np.ndarray | None] = []
    for c in counted:
        if not c:
            out.append(None)
            continue
        mine, times = np.unique([number[t] for t in c], return_counts=True)
        size = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        v = np.bincount(cells[at], weights=signs[at] * np.repeat(times, size), minlength=dim).astype(np.float32)
        v *= np.float32(1) / np.float32(len(c))
        length = np.float32(np.sqrt((v.astype(np.float64) ** 2).sum()))
        out.append(v / length if length else None)
    return out


def vector(text: str | None, dim: int = DIMENSION, shortest: int = SHORTEST, longest: int = LONGEST, seeds: tuple[str, str] = SEEDS) -> np.ndarray | None:
    return vectors([text or ""], dim, shortest, longest, seeds)[0]


Embedder = Callable[[list[str]], list[list[float] | None]]


def local(dim: int = DIMENSION, seeds: tuple[str, str] = SEEDS) -> Embedder:
    def run(texts: list[str]) -> list[list[float] | None]:
        return [None if v is None else v.tolist() for v in vectors(texts, dim, seeds=seeds)]

    return run


def embedded(docs: DataFrame, embedder: Embedder | None = None, text: str = "content", batch: int = 256, partitions: int | None = None) -> DataFrame:
    """``docs`` with ``embedding`` and ``embed_error``: a text that can't be embedded has a null vector and says why.

    ``partitions`` deals the rows evenly first, for inputs of few splits: moving a text costs far less than embedding it.
    """
    embedder = embedder or local()
    docs = docs.repartition(partitions) if partitions else docs
    schema = docs.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embed_error", F.lit(None).cast("string")).schema

    def run(batches):
        for pdf in batches:
            texts, vectors = pdf[text].fillna("").tolist(), []
            for a in range(0, len(texts), batch):
                vectors += embedder(texts[a : a + batch])
            yield pdf.assign(embedding=vectors, embed_error=[None if v is not None else "no indexable words" for v in vectors])

    return docs.mapInPandas(run, schema)


def remote(post: Callable[[dict], dict], model: str) -> Embedder:
    """An embedder behind an HTTP API of the ``{"model", "input"} -> {"data": [{"index", "embedding"}]}`` form; ``post`` sends one request."""

    def run(texts: list[str]) -> list[list[float] | None]:
        data = post({"model": model, "input": texts})["data"]
        if len(data) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(data)} vectors")
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    return run
