"""Bisecting k-means trees, walked by every row."""

from __future__ import annotations

import heapq

import numpy as np

__all__ = ["Tree", "fit_tree", "two_means", "power_direction"]


def power_direction(squares: np.ndarray) -> np.ndarray | None:
    """About the direction of the largest spread, by a few power steps on the sums of products of offsets from the mean."""
    spread = np.diag(squares)
    if not spread.max() > 0:
        return None
    w = np.where(spread == spread.max(), 1.0, 0.1)
    for _ in range(6):
        w = squares @ w
        size = np.linalg.norm(w)
        if not size > 0:
            return None
        w /= size
    return w


def two_means(x: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray] | None:
    """Two centres of the rows of x, or None where all rows are equal. Starts from the halves about the mean along the
    direction of the largest spread, found by a few power steps, so that the result is deterministic."""
    mean = x.mean(0)
    d = x - mean
    spread = (d * d).sum(0)
    if not spread.max() > 0:
        return None
    w = np.where(spread == spread.max(), 1.0, 0.1)
    for _ in range(6):
        w = d.T @ (d @ w)
        size = np.linalg.norm(w)
        if not size > 0:
            return None
        w /= size
    side = d @ w > 0
    for _ in range(rounds):
        if side.all() or not side.any():
            return None
        a, b = x[~side].mean(0), x[side].mean(0)
        new = ((x - (a + b) / 2) @ (b - a)) > 0
        if np.array_equal(new, side):
            break
        side = new
    if side.all() or not side.any():
        return None
    return x[~side].mean(0), x[side].mean(0)


class Tree:
    """normal[i] . x > offset[i] goes to right[i], else to left[i]; a negative child -k-1 is leaf k. normals are of unit length,
    so that normal . x - offset is the distance from the plane."""

    def __init__(self, normal, offset, left, right, centres):
        self.normal, self.offset, self.left, self.right, self.centres = normal, offset, left, right, centres

    def leaves(self, x: np.ndarray, halo: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): each row once with home true, and with home false once for every other leaf that comes nearer
        than ``halo`` to it along each of the planes passed."""
        rows, leaf, home = [], [], []
        if not len(self.offset):
            n = len(x)
            return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
        todo = [(0, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaf.append(np.full(len(at), -node - 1, np.int64))
                home.append(own)
                continue
            m = x[at] @ self.normal[node] - self.offset[node]
            right = m > 0
            for child, inside, near in ((self.right[node], right, m > -halo), (self.left[node], ~right, m <= halo)):
                keep = inside | near if halo > 0 else inside
                todo.append((child, at[keep], own[keep] & inside[keep]))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        return np.concatenate(rows), np.concatenate(leaf), np.concatenate(home)


    def grown(self, split: dict) -> tuple["Tree", list[int]]:
        """The tree with each leaf of ``split`` parted half-way between its two centres, and the new leaves' numbers. The other leaves
        keep theirs."""
        normal, offset, left, right, new = list(self.normal), list(self.offset), list(self.left), list(self.right), []
        leaves = len(self.offset) + 1
        for k, (a, b) in split.items():
            w = (b - a) / np.linalg.norm(b - a)
            here = len(offset)
            for side in (left, right):
                for i, child in enumerate(side):
                    if child == -k - 1:
                        side[i] = here
            normal.append(w)
            offset.append(float(w @ ((a + b) / 2)))
            left.append(-k - 1)
            right.append(-leaves - 1)
            new += [k, leaves]
            leaves += 1
        return Tree(np.array(normal).reshape(-1, self.normal.shape[1]), np.array(offset), left, right, self.centres), new


def fit_tree(x: np.ndarray, most: float, radius: float = 0.0, leaves: int = 1 << 20) -> Tree:
    """Splits the node of the largest dispersion (sum of squares about its mean) again and again, until each leaf holds at
    most ``most`` rows of x or lies within ``radius`` of its mean, or there are ``leaves`` leaves."""
    normal, offset, left, right, centres = [], [], [], [], []
    if not len(x):
        return Tree(np.zeros((0, x.shape[1])), np.zeros(0), [], [], np.zeros((1, x.shape[1])))

    def node(at):
        d = x[at] - x[at].mean(0)
        q = (d * d).sum(1)
        return q.sum(), len(at) > most and q.max() > radius * radius

    heap, done, n = [], [], 0
    total, go = node(np.arange(len(x)))
    heap.append((-total, 0, np.arange(len(x)), None, go))
    while heap:
        _, _, at, parent, go = heapq.heappop(heap)
        pair = two_means(x[at]) if go and len(heap) + len(done) + 1 < leaves else None
        if pair is None:
            done.append((at, parent))
            continue
        a, b = pair
        w = b - a
        w /= np.linalg.norm(w)
        t = float(w @ ((a + b) / 2))
        side = x[at] @ w - t > 0
        if side.all() or not side.any():
            done.append((at, parent))
            continue
        here = len(offset)
        normal.append(w)
        offset.append(t)
        left.append(None)
        right.append(None)
        if parent is not None:
            (right if parent[1] else left)[parent[0]] = here
        for which in (0, 1):
            part = at[side] if which else at[~side]
            total, go = node(part)
            n += 1
            heapq.heappush(heap, (-total, n, part, (here, which), go))
    for k, (at, parent) in enumerate(done):
        centres.append(x[at].mean(0))
        if parent is not None:
            (right if parent[1] else left)[parent[0]] = -k - 1
    return Tree(np.array(normal).reshape(-1, x.shape[1]), np.array(offset), left, right, np.array(centres))
