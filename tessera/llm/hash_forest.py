"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``trees`` trees labels a vector with a long string of sign bits of
random projections and keeps the strings of a block sorted.  A query descends
in every tree to the longest prefix that its own string shares with a stored
one, then all trees ascend together, a bit at a time; what stands under the
current prefixes is scored exactly by cosine.

Two vectors at angle ``a`` agree in a bit with probability ``p = 1 - a / pi``,
so one as near as the kth found so far stands under a prefix of ``d`` bits in one
of ``t`` trees with probability ``1 - (1 - p**d)**t``.  The ascent ends when that
reaches ``recall``, whatever the size of the block.  Near vectors are found after a
few candidates; where all vectors are far apart no prefix is telling, and a
good part of the block is scored.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame

from .vectors import BLOCK_ROWS, QUERY_ROWS, blocked, searched, usable

TREES, BITS, RECALL, SEED = 64, 64, 0.9, 20_240_607


def _strings(x: np.ndarray, trees: int) -> np.ndarray:
    """[tree, row] hash strings as integers, first bit highest."""
    planes = np.random.default_rng(SEED).standard_normal((trees, BITS, x.shape[1]))
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return np.array([((x @ p.T) > 0).astype(np.uint64) @ weights for p in planes])


def build(trees: int):
    def run(ids: np.ndarray, x: np.ndarray) -> bytes:
        strings = _strings(x, trees)
        order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        return pickle.dumps((ids, x, np.take_along_axis(strings, order, axis=1), order))

    return run


def _plain(ids: np.ndarray, x: np.ndarray) -> bytes:
    return pickle.dumps((ids, x))


def _search(k: int, recall: float):
    def run(queries: bytes, index: bytes):
        q_ids, q = pickle.loads(queries)
        ids, x, strings, order = pickle.loads(index)
        labels, n, trees = _strings(q, len(strings)), len(ids), len(strings)
        norms = np.sqrt((x * x).sum(axis=1))
        low = np.empty((BITS + 1, *labels.shape), dtype=np.int32)
        high = np.empty_like(low)
        for level in range(BITS + 1):
            free = np.uint64((1 << (BITS - level)) - 1)
            for t, row in enumerate(strings):
                low[level, t] = np.searchsorted(row, labels[t] & ~free, side="left")
                high[level, t] = np.searchsorted(row, labels[t] | free, side="right")
        under = (high - low).sum(axis=1)  # at each level, with repeats
        # The least probability of an equal bit with which ``recall`` is reached at each level.
        enough = np.r_[0.0, (1 - (1 - recall) ** (1 / trees)) ** (1 / np.arange(1, BITS + 1))]
        out = [[], [], []]
        for i in range(len(q_ids)):
            spot = np.searchsorted(ids, q_ids[i]) % n
            seen = np.zeros(n, dtype=bool)
            seen[spot] = ids[spot] == q_ids[i]
            at, score, length = np.zeros(0, np.int64), np.zeros(0), np.sqrt((q[i] * q[i]).sum())
            # Below this level even with repeats there are too few.
            level = int(np.flatnonzero(under[:, i] >= min(k + 1, under[0, i]))[-1])
            old_low = old_high = None
            while True:
                now_low, now_high = low[level, :, i], high[level, :, i]
                if old_low is None:
                    spans = [(t, a, b) for t, (a, b) in enumerate(zip(now_low.tolist(), now_high.tolist(), strict=True)) if a < b]
                else:
                    both = zip(now_low.tolist(), old_low.tolist(), old_high.tolist(), now_high.tolist(), strict=True)
                    spans = [s for t, (a, b, c, d) in enumerate(both) for s in ((t, a, b), (t, c, d)) if s[1] < s[2]]
                found = np.unique(np.concatenate([order[t, a:b] for t, a, b in spans])) if spans else np.zeros(0, np.int64)
                found = found[~seen[found]]
                seen[found] = True
                at = np.r_[at, found]
                score = np.r_[score, (x[found] * q[i]).sum(axis=1) / (norms[found] * length)]
                if len(at) > k:
                    keep = score >= np.partition(score, -k)[-k]
                    at, score = at[keep], score[keep]
                old_low, old_high = now_low, now_high
                if level == 0 or (len(at) >= k and 1 - np.arccos(np.clip(score.min(), -1, 1)) / np.pi >= enough[level]):
                    break
                level -= 1
            top = np.lexsort((ids[at], -score))[:k]
            out[0].append(np.full(len(top), q_ids[i]))
            out[1].append(ids[at[top]])
            out[2].append(score[top])
        return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    embedding: str = "embedding",
    trees: int = TREES,
    recall: float = RECALL,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest of the rows of ``vectors`` with another key.

    Score is the cosine of the original vectors in double precision; ties go to the smaller key.  Each of the ``k`` is
    found with probability ``recall`` at least.  Every row is indexed.  Rows without a key, and null, empty or all-zero vectors and those with null or non-finite components
    take no part.  A repeated key counts once, by its smallest vector.  Vectors are compared with those of their own
    length.  Fewer candidates than ``k`` give fewer rows, an empty table none.
    """
    index = blocked(usable(vectors, key, embedding, zero=False), block_rows, build(trees), "hash-forest")
    asked = blocked(usable(queries, key, embedding, zero=False), query_rows, _plain, "hash-forest-queries")
    return searched(asked, index, _search(k, recall), "double", k)
