"""Small models in numpy: boosted trees, logistic regression, isotonic calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Gradient-boosted trees for 0/1 labels on quantile bins; every tree is complete to `depth`."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        q, n, f = self._bin(x), len(y), x.shape[1]
        p = (y.sum() + 0.5) / (n + 1.0)
        self.start = float(np.log(p / (1 - p)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out = np.full(n, self.start)
        width = self.bins + 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-out))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            node = np.zeros(n, np.int64)
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, width, np.int64)
            for level in range(self.depth):
                m, base = 2**level, 2**level - 1
                best = np.full(m, 1e-9)
                for j in range(f):
                    at = node * width + q[:, j]
                    gs = np.bincount(at, g, m * width).reshape(m, width)
                    hs = np.bincount(at, h, m * width).reshape(m, width)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.ridge) + (ga - gl) ** 2 / (ha - hl + self.ridge) - ga**2 / (ha + self.ridge)
                    k = gain.argmax(1)
                    top = gain[np.arange(m), k]
                    win = top > best
                    best[win] = top[win]
                    feature[base + np.flatnonzero(win)] = j
                    cut[base + np.flatnonzero(win)] = k[win]
                node = 2 * node + (q[np.arange(n), feature[base + node]] > cut[base + node])
            leaves = 2**self.depth
            value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge) * self.rate
            out += value[node]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        q, n = self._bin(x), len(x)
        out, own = np.full(n, self.start), np.arange(n)
        for feature, cut, value in self.trees:
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (q[own, feature[at]] > cut[at])
            out += value[node]
        return out


class Isotonic:
    """Non-decreasing map to probabilities by pooling neighbours that violate the order, linear between pools."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        at, inv = np.unique(x, return_inverse=True)  # equal scores are one pool from the start
        n, total = np.bincount(inv, minlength=len(at)), np.bincount(inv, y, len(at))
        pools: list[list[float]] = []  # sum, count, sum of x
        for a, c, b in zip(at.tolist(), n.tolist(), total.tolist()):
            pools.append([b, float(c), a * c])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                s, n, t = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
        self.x = np.array([t / n for _, n, t in pools]) if pools else np.zeros(1)
        self.y = np.array([s / n for s, n, _ in pools]) if pools else np.zeros(1)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0.0, 1.0)


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, ridge: float = 1.0, steps: int = 8):
        self.ridge, self.steps = ridge, steps

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.sd, -8, 8), np.ones(len(x))]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            r = np.maximum(p * (1 - p), 1e-4)
            step = np.linalg.solve((z * r[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-4:
                break
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.w


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a positive scores above a negative; ties count half."""
    _, inv, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inv]
    p = y.sum()
    q = len(y) - p
    return float((rank[y == 1].sum() - p * (p + 1) / 2) / (p * q)) if p and q else 0.5
