"""Gradient-boosted trees on dense features, and isotonic calibration."""

from __future__ import annotations

import numpy as np

from docloom.llm.training import sigmoid


class Trees:
    """Boosted trees of a fixed depth for the logistic loss, split by histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, damp: float = 2.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        # A value in the middle between neighbours, so that rare values beyond a plateau can be told from it.
        self.cuts = [np.unique(np.concatenate([q, [v + 1e-9 for v in (c.min(),)]])) for q, c in zip(self.cuts, x.T)]
        self.depth, self.base, self.trees = depth, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
        b = self._binned(x)
        wide = max(len(c) for c in self.cuts) + 1
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            p = sigmoid(f)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            at, feature, cut = np.zeros(len(y), np.int64), np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, wide)
            for level in range(depth):
                first, nodes = 2**level - 1, 2**level
                best = np.zeros(nodes)
                for j in range(b.shape[1]):
                    slot = at * wide + b[:, j]
                    gs = np.bincount(slot, g, nodes * wide).reshape(nodes, wide)
                    hs = np.bincount(slot, h, nodes * wide).reshape(nodes, wide)
                    gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                    ga, ha = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                    gain = gl**2 / (hl + damp) + (ga - gl) ** 2 / (ha - hl + damp) - ga**2 / (ha + damp)
                    gain[(hl < 0.5) | (ha - hl < 0.5)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), k]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feature[first : first + nodes][better], cut[first : first + nodes][better] = j, k[better]
                at = 2 * at + (b[np.arange(len(y)), feature[first + at]] > cut[first + at])
            g_leaf, h_leaf = np.bincount(at, g, 2**depth), np.bincount(at, h, 2**depth)
            leaf = -rate * g_leaf / (h_leaf + damp)
            self.trees.append((feature, cut, leaf))
            f += leaf[at]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (b[rows, feature[node]] > cut[node])
            f += leaf[at]
        return f


class Isotonic:
    """The non-decreasing step function of least squares, by pooling adjacent violators; linear between steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of y, weight, least x, greatest x
        for at, value in zip(x[order], y[order]):
            pools.append([value, 1.0, at, at])
            while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
                s, w, _, high = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], high]
        # Half a row of either kind keeps pools of one kind off 0 and 1.
        share = np.array([(s + 0.5) / (w + 1) for s, w, _, _ in pools])
        self.x = np.array([v for p in pools for v in p[2:]])
        self.y = np.maximum.accumulate(np.repeat(share, 2))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
