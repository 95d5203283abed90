"""Vantage-point trees over norm-augmented vectors.

With M at least every norm, a vector c gets one more component sqrt(M^2 - |c|^2) and a query q gets a zero there, so that the squared distance is
|q|^2 + M^2 - 2 q.c: the highest score is the nearest point, and a window of scores is an annulus. Distances are floating-point numbers and only choose where to
look, with room for their rounding; scores are exact integers.
"""

from __future__ import annotations

import heapq
import io

import numpy as np

#: Rows under one node that has no children, at most.
LEAF = 128
EPS = float(np.finfo(float).eps)


def exact_products(x: np.ndarray, xf: np.ndarray, x_top: int, q: np.ndarray, q_top: int) -> np.ndarray:
    """Exact inner products of q with rows, with room to multiply them by 100; Python integers where 64 bits do not do."""
    bound = 100 * x_top * q_top * max(1, x.shape[1])
    if bound < 1 << 53:
        return (xf @ q.astype(float)).astype(np.int64)
    if bound < 1 << 63:
        return x.astype(np.int64) @ q.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x] or [0], object)[: len(x)]


def top_of(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


class Geometry:
    """What distances allow to say about scores; M is at least every norm."""

    def __init__(self, m: float, dims: int):
        self.m2 = m * m * (1 + 1e-9) + 1
        self.m = self.m2**0.5
        slack = 64 * EPS * (dims + 16)
        self.room, self.score_room = self.m * slack**0.5, self.m2 * slack

    def rest(self, f: np.ndarray) -> np.ndarray:
        """The further component of each row."""
        return np.sqrt(np.maximum(self.m2 - (f * f).sum(axis=-1), 0))

    def distance(self, f: np.ndarray, rest: np.ndarray, p: np.ndarray, p_rest: float) -> np.ndarray:
        return np.sqrt(np.maximum(((f - p) ** 2).sum(axis=-1) + (rest - p_rest) ** 2, 0))

    def from_query(self, q: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q @ q) + self.m2 - 2 * (f @ q), 0))

    def at_most(self, q2: float, d: float) -> float:
        """The highest score at a distance of d or more from a query whose squared norm is q2."""
        return (q2 + self.m2 - max(d - self.room, 0.0) ** 2) / 2 + self.score_room

    def at_least(self, q2: float, d: float) -> float:
        """The lowest score at a distance of d or less."""
        return (q2 + self.m2 - (d + self.room) ** 2) / 2 - self.score_room


class Router:
    """The top of the tree, from a bounded sample: tells each vector its leaf, and each query what scores a leaf can hold."""

    def __init__(self, sample: np.ndarray, leaves: int, m: float):
        f = sample.astype(float)
        self.geometry = Geometry(m, f.shape[1])
        self.rest = self.geometry.rest(f)
        self.nodes: list[tuple] = []  # (vantage point, its rest, radius, inside, outside); a child below zero is the leaf ~child
        self.leaves = 0
        self.f = f
        self.root = self._build(np.arange(len(f)), leaves)

    def _build(self, rows: np.ndarray, leaves: int) -> int:
        if leaves < 2 or len(rows) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        p, p_rest = self.f[rows[0]], self.rest[rows[0]]
        d = self.geometry.distance(self.f[rows], self.rest[rows], p, p_rest)
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # copies of one vector, or nearly
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.nodes)
        self.nodes.append(())
        a = self._build(rows[inside][1:] if inside.sum() > 1 else rows[inside], leaves // 2)
        b = self._build(rows[~inside], leaves - leaves // 2)
        self.nodes[at] = (p, p_rest, radius, a, b)
        return at

    def leaf_of(self, f: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, rest, todo = np.zeros(len(f), np.int32), self.geometry.rest(f), [(self.root, np.arange(len(f)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            p, p_rest, radius, a, b = self.nodes[node]
            inside = self.geometry.distance(f[rows], rest[rows], p, p_rest) <= radius
            todo += [(a, rows[inside]), (b, rows[~inside])]
        return out

    def annuli(self, q: np.ndarray) -> list[tuple[int, float, float]]:
        """For each leaf the highest and lowest score that it may hold for q."""
        g, q2 = self.geometry, float(q @ q)
        out, todo = [], [(self.root, 0.0, float("inf"))]
        d = g.from_query(q, np.array([n[0] for n in self.nodes])) if self.nodes else np.zeros(0)
        while todo:
            node, near, far = todo.pop()
            if node < 0:
                out.append((~node, g.at_most(q2, near), g.at_least(q2, far)))
                continue
            radius, a, b = self.nodes[node][2:]
            todo.append((a, max(near, d[node] - radius - g.room), min(far, d[node] + radius + g.room)))
            todo.append((b, max(near, radius - d[node] - g.room), far))
        return out


class VpTree:
    """A tree of one block: rows in the order of the leaves; a node is a range of rows with a vantage point and the hulls of its halves' distances."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, nodes: np.ndarray | None = None, hulls: np.ndarray | None = None):
        self.ids, self.labels, self.x, self.f = ids, labels, x, x.astype(float)
        self.top = top_of(x)
        self.geometry = Geometry(float(np.sqrt((self.f**2).sum(axis=1).max())) if len(x) else 0.0, x.shape[1])
        self.nodes, self.hulls = nodes, hulls
        if nodes is not None:
            self.inner = np.flatnonzero(nodes[:, 2] >= 0)
            self.points = self.f[nodes[self.inner, 2]]

    @classmethod
    def build(cls, ids, labels, x) -> VpTree:
        self = cls(ids, labels, x)
        g, rest = self.geometry, self.geometry.rest(self.f)
        order = np.arange(len(ids))
        nodes, hulls, todo = [], [], [(0, len(ids), -1)]
        while todo:
            a, b, above = todo.pop()
            at = len(nodes)
            if above >= 0:
                nodes[above][3 if nodes[above][3] < 0 else 4] = at
            nodes.append([a, b, -1, -1, -1])
            hulls.append((0.0,) * 4)
            if b - a <= LEAF:
                continue
            rows = order[a:b]
            v = rows[0]
            d = g.distance(self.f[rows], rest[rows], self.f[v], rest[v])
            by, half = np.argsort(d, kind="stable"), (b - a) // 2
            order[a:b], d = rows[by], d[by]
            nodes[at][2] = v
            hulls[at] = (d[0], d[half - 1], d[half], d[-1])
            todo += [(a + half, b, at), (a, a + half, at)]  # the inner half is numbered first
        place = np.argsort(order)
        nodes = np.array(nodes, np.int64)
        nodes[:, 2] = np.where(nodes[:, 2] >= 0, place[nodes[:, 2]], -1)
        return cls(ids[order], labels[order], x[order], nodes, np.array(hulls))

    def packed(self) -> bytes:
        out = io.BytesIO()
        small = next(t for t in (np.int16, np.int32, np.int64) if self.top <= np.iinfo(t).max)
        for a in (self.ids, self.labels, self.x.astype(small), self.nodes, self.hulls):
            np.save(out, a, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> VpTree:
        f = io.BytesIO(data)
        return cls(*(np.load(f, allow_pickle=False) for _ in range(5)))

    def asked(self, q: np.ndarray) -> Asked:
        return Asked(self, q)


class Asked:
    """A query at a tree; what it has computed is kept for its further windows."""

    def __init__(self, tree: VpTree, q: np.ndarray):
        self.tree, self.q, self.qf, self.q_top = tree, q, q.astype(float), top_of(q)
        self.q2 = float(self.qf @ self.qf)
        self.d = dict(zip(tree.inner.tolist(), tree.geometry.from_query(self.qf, tree.points).tolist(), strict=True)) if len(tree.inner) else {}
        self.scores: dict[int, np.ndarray] = {}
        self.rows = 0

    def nearest(self, k: int, wanted, low=None, high=None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows with low <= score <= high that `wanted` (a mask of rows) names: nearest first, ties by smaller id.

        Nodes come from a queue in the order of the highest score that they may hold, and those wholly inside the annulus' inner circle are passed by.
        """
        t, g = self.tree, self.tree.geometry
        best: list[tuple[int, int]] = []
        queue = [(-float("inf"), 0, 0.0, float("inf"))]
        while queue:
            up, node, near, far = heapq.heappop(queue)
            floor = -best[-1][0] if len(best) == k else low
            if floor is not None and -up < floor:
                break
            a, b, v, left, right = t.nodes[node].tolist()
            if v < 0:
                s = self.scores.get(node)
                if s is None:
                    s = self.scores[node] = exact_products(t.x[a:b], t.f[a:b], t.top, self.q, self.q_top)
                    self.rows += b - a
                fit = wanted[a:b].copy()
                if floor is not None:
                    fit &= (s >= floor).astype(bool)
                if high is not None:
                    fit &= (s <= high).astype(bool)
                at = np.flatnonzero(fit)
                if len(at):
                    best = sorted([*best, *zip((-s[at]).tolist(), t.ids[a:b][at].tolist(), strict=True)])[:k]
                continue
            d, (lo1, hi1, lo2, hi2) = self.d[node], t.hulls[node].tolist()
            for child, lo, hi in ((left, lo1, hi1), (right, lo2, hi2)):
                n, f = max(near, d - hi - g.room, lo - d - g.room), min(far, d + hi + g.room)
                if high is not None and g.at_least(self.q2, f) > high:
                    continue
                heapq.heappush(queue, (-g.at_most(self.q2, n), child, n, f))
        return [(-s, i) for s, i in best]
