"""Small gradient-boosted trees in numpy, for the bounded samples that models here are trained on.

Trees come out as flat node arrays, so that a batch is scored by moving all its rows down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Flat nodes of all trees. ``left`` of a leaf is the leaf itself; rows go right where the value is above ``at``."""

    roots: np.ndarray
    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            above = x[rows, self.feature[node]] > self.at[node]
            node = np.where(above, self.right[node], self.left[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32,
    direction: np.ndarray | None = None, least: float = 5.0, ridge: float = 1.0, share: float = 1.0, seed: int = 0,
) -> Forest:
    """Logistic boosting over quantile bins.

    ``direction`` holds +1, -1 or 0 per feature: the score never falls (rises) as that feature grows. A split against the direction is not made, and
    each side's leaves are kept on their side of the two values' middle, which makes whole trees monotonic. ``share`` of the rows is drawn for each tree.
    Without rows, or with one class only, the forest is its base value.
    """
    n, m = x.shape
    direction = np.zeros(m, int) if direction is None else direction
    p = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), int)
    roots, nodes, margin, rng = [], [], np.full(n, base), np.random.default_rng(seed)

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple | None:
        found, all_g, all_h = None, g[rows].sum(), h[rows].sum()
        for j in range(m):
            if not len(edges[j]):
                continue
            code = coded[rows, j]
            gl = np.cumsum(np.bincount(code, g[rows], len(edges[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(code, h[rows], len(edges[j]) + 1))[:-1]
            gr, hr = all_g - gl, all_h - hl
            wl, wr = -gl / (hl + ridge), -gr / (hr + ridge)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - all_g**2 / (all_h + ridge)
            gain[(hl < least / 4) | (hr < least / 4) | (direction[j] * (wr - wl) < 0)] = 0
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (found is None or gain[k] > found[0]):
                found = (gain[k], j, k, wl[k], wr[k])
        return found

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, me, me, value * rate])
        split = best_split(rows, g, h) if level < depth and len(rows) >= 2 * least else None
        if split:
            _, j, k, wl, wr = split
            middle = float(np.clip((wl + wr) / 2, low, high))
            to_left, to_right = ((low, middle), (middle, high)) if direction[j] > 0 else ((middle, high), (low, middle)) if direction[j] < 0 else ((low, high), (low, high))
            goes = coded[rows, j] <= k
            nodes[me][:2] = j, float(edges[j][k])
            nodes[me][2] = grow(rows[goes], level + 1, *to_left, g, h)
            nodes[me][3] = grow(rows[~goes], level + 1, *to_right, g, h)
        return me

    for _ in range(trees if n else 0):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        rows = np.arange(n) if share >= 1 else np.flatnonzero(rng.random(n) < share)
        if not len(rows):
            continue
        first = len(nodes)
        roots.append(grow(rows, 0, -np.inf, np.inf, g, h))
        one = _flat([first], nodes, 0.0, depth)
        margin = margin + one.margin(x)
    return _flat(roots, nodes, base, depth)


def _flat(roots: list[int], nodes: list[list], base: float, depth: int) -> Forest:
    a = list(zip(*nodes)) if nodes else [()] * 5
    return Forest(np.array(roots, int), np.array(a[0], int), np.array(a[1], float), np.array(a[2], int), np.array(a[3], int), np.array(a[4], float), base, depth)
