"""Exact top-k inner products by dual-tree search over cover trees.

Both the queries and the data of a block are indexed by a cover tree: each
node has one of its points as its centre and covers its points within a radius;
its children are a net of them: centres, the first being its own, that lie
further apart than the radius they cover, which shrinks by a constant factor
per level.  Children of few points would cost more to visit than to compare, so
the points of such siblings are read together in leaves, by falling length.

Node pairs are taken best first.  A pair's products are at most

    centre . centre + radius_d |centre_q| + radius_q |centre_d| + radius_q radius_d

and at most the product of the greatest lengths times the cosine of what the
nodes' widest angles leave of the angle between their centres.  A pair goes when
that is below the worst kth score of the query node's queries; the queries of a
leaf are held against a data node one by one.  Leaves are compared point by
point, in integers.

Where all vectors are about equally far apart, a net of smaller radius holds every
point and no bound prunes: such data are compared in full.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
from pyspark.sql import DataFrame

from .vectors import BLOCK_ROWS, QUERY_ROWS, blocked, searched, usable

BASE, LEAF, SCALE = 1.3, 32, 1024.0
#: Points whose distances to all others of a node are computed at once.
BATCH = 256
#: Integer sums up to this are exact in double precision.
EXACT = float(1 << 53)


def _net(x: np.ndarray, points: np.ndarray, centre: int, cover: float) -> list[np.ndarray]:
    """The points by the first centre that covers each; a group's first point is its centre, and ``centre`` is the first one."""
    rest, groups = np.r_[centre, points[points != centre]], []
    while len(rest):
        batch = rest[:BATCH]
        square = (x[rest] ** 2).sum(axis=1)
        near = square[:, None] + square[: len(batch)] - 2 * (x[rest] @ x[batch].T) <= cover * cover
        near[np.arange(len(batch)), np.arange(len(batch))] = True
        chosen, taken = [], np.zeros(len(batch), dtype=bool)
        for j in range(len(batch)):
            if not taken[j]:
                chosen.append(j)
                taken |= near[: len(batch), j]
        mine = near[:, chosen]
        covered = mine.any(axis=1)
        own = mine[covered].argmax(axis=1)
        order = np.argsort(own, kind="stable")  # a centre precedes what it covers
        groups += np.split(rest[covered][order], np.flatnonzero(np.diff(own[order])) + 1)
        rest = rest[~covered]
    return groups


def tree(x: np.ndarray, leaf: int = LEAF, base: float = BASE) -> list[tuple[int, float, np.ndarray, list[int]]]:
    """Nodes (centre, radius, points, children); a leaf has no children.  Node 0 is the root."""
    nodes: list[tuple[int, float, np.ndarray, list[int]]] = []
    stack = [(0, np.arange(len(x)), -1)]
    lengths = (x * x).sum(axis=1)
    while stack:
        centre, points, parent = stack.pop()
        radius = float(np.sqrt(((x[points] - x[centre]) ** 2).sum(axis=1)).max())
        me = len(nodes)
        nodes.append((centre, radius, points, []))
        if parent >= 0:
            nodes[parent][3].append(me)
        if len(points) <= leaf or radius == 0:
            continue
        few = []
        for group in _net(x, points, centre, radius / base):
            if 4 * len(group) >= leaf:
                stack.append((int(group[0]), group, me))
            else:
                few.append(group)
        if few:
            loose = np.concatenate(few)
            loose = loose[np.argsort(-lengths[loose], kind="stable")]
            stack += [(int(loose[i]), loose[i : i + leaf], me) for i in range(0, len(loose), leaf)]
    return nodes


def _build(ids: np.ndarray, x: np.ndarray) -> bytes:
    whole = np.floor(SCALE * x)
    return pickle.dumps((ids, whole, tree(whole)))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products; beyond double precision by Python integers."""
    with np.errstate(over="ignore"):
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
            return a @ b.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object)
    return whole(a) @ whole(b).T


class Bounds:
    """What the bounds need of the nodes of a tree."""

    def __init__(self, x: np.ndarray, nodes: list):
        length = np.sqrt((x * x).sum(axis=1))
        self.at = np.array([n[0] for n in nodes])
        self.far = np.array([n[1] for n in nodes])
        self.length = length[self.at]
        self.longest = np.array([length[n[2]].max() for n in nodes])
        self.angle = np.empty(len(nodes))
        for i, (centre, _, points, _) in enumerate(nodes):
            sizes = length[points] * length[centre]
            cosine = (x[points] @ x[centre] / np.where(sizes > 0, sizes, 1.0)).min() if sizes.all() else -1.0
            self.angle[i] = np.arccos(np.clip(cosine, -1, 1)) + 1e-6


def _search(k: int, tally: list[tuple[int, int]] | None = None):
    """``tally`` gets how many products were computed and how many pairs there are."""

    def run(queries: bytes, index: bytes):
        q_ids, q, q_tree = pickle.loads(queries)
        ids, x, x_tree = pickle.loads(index)
        q_is, x_is = Bounds(q, q_tree), Bounds(x, x_tree)
        small = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT
        kind = np.float64 if small else object
        best = np.full((len(q), k), -np.inf, dtype=kind)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        inner = [len(n[3]) > 0 for n in q_tree], [len(n[3]) > 0 for n in x_tree]
        compared = 0

        def bounded(centre: np.ndarray, far, length, longest, angle, b: list[int]) -> np.ndarray:
            mid = centre @ x[x_is.at[b]].T
            ball = mid + x_is.far[b] * length[:, None] + far[:, None] * (x_is.length[b] + x_is.far[b])
            sizes = length[:, None] * x_is.length[b]
            between = np.arccos(np.clip(mid / np.where(sizes > 0, sizes, 1.0), -1, 1)) * (sizes > 0)
            left = np.maximum(between - angle[:, None] - x_is.angle[b], 0.0)
            cone = longest[:, None] * x_is.longest[b] * np.maximum(np.cos(np.minimum(left, np.pi)), 0.0)
            out = np.minimum(ball, cone)
            return out + 1e-9 * np.abs(out) + 1.0

        def bounds(a: list[int], b: list[int]) -> np.ndarray:
            return bounded(q[q_is.at[a]], q_is.far[a], q_is.length[a], q_is.longest[a], q_is.angle[a], b)

        q_length, nothing = np.sqrt((q * q).sum(axis=1)), np.zeros(len(q))

        def single(points: np.ndarray, b: list[int]) -> np.ndarray:
            """Bounds of queries one by one: each is a node of its own."""
            zero = nothing[points]
            return bounded(q[points], zero, q_length[points], q_length[points], zero + 1e-6, b)

        heap = [(-float(bounds([0], [0])[0, 0]), 0, 0)]
        while heap:
            bound, a, b = heapq.heappop(heap)
            points = q_tree[a][2]
            if -bound < best[points, -1].min():
                continue
            if not inner[0][a] and inner[1][b]:
                two = x_tree[b][3]
                got = single(points, two)
                got = np.where(got >= best[points, -1][:, None], got, -np.inf).max(axis=0)
                for j in np.flatnonzero(got > -np.inf).tolist():
                    heapq.heappush(heap, (-float(got[j]), a, two[j]))
                continue
            if inner[0][a]:
                split_q = inner[0][a] and (not inner[1][b] or q_is.far[a] >= x_is.far[b])
                one, two = (q_tree[a][3], [b]) if split_q else ([a], x_tree[b][3])
                got = bounds(one, two)
                worst = [best[q_tree[c][2], -1].min() for c in one]
                for i, c in enumerate(one):
                    for j in np.flatnonzero(got[i] >= worst[i]).tolist():
                        heapq.heappush(heap, (-float(got[i, j]), c, two[j]))
                continue
            data = x_tree[b][2]
            data = data[np.argsort(ids[data])]
            points = points[single(points, [b])[:, 0] >= best[points, -1]]
            score = _exact(q[points], x[data])
            compared += score.size
            if not small:
                score = score.astype(object)
            score[q_ids[points][:, None] == ids[data][None, :]] = -np.inf
            better = np.flatnonzero((score >= best[points, -1][:, None]).any(axis=1))
            if len(better):
                p = points[better]
                s, w = np.concatenate([best[p], score[better]], axis=1), np.concatenate([who[p], np.broadcast_to(ids[data], (len(p), len(data)))], axis=1)
                w[s == -np.inf] = np.iinfo(np.int64).max
                order = np.argsort(w, axis=1, kind="stable")
                s, w = np.take_along_axis(s, order, axis=1), np.take_along_axis(w, order, axis=1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best[p], who[p] = np.take_along_axis(s, order, axis=1), np.take_along_axis(w, order, axis=1)
        if tally is not None:
            tally.append((compared, len(q) * len(x)))
        row, col = np.nonzero(who != np.iinfo(np.int64).max)
        return q_ids[row], who[row, col], np.array([int(v) for v in best[row, col]], dtype=object)

    return run


def top_products(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products with rows of another key, exactly.

    Components count as ``floor(1024 * x)``.  Ties go to the smaller key.  Rows without a key, and vectors null,
    empty or with null or non-finite components take no part; zero vectors do.  A repeated key counts once, by its
    smallest vector.  Vectors are compared with those of their own length.  Fewer candidates than ``k`` give fewer
    rows, an empty table none.  Scores must fit a 64-bit integer.
    """
    index = blocked(usable(vectors, key, embedding, zero=True), block_rows, _build, "cover-tree")
    asked = blocked(usable(queries, key, embedding, zero=True), query_rows, _build, "cover-tree-queries")
    return searched(asked, index, _search(k), "long", k)
