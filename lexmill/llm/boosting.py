"""Gradient-boosted trees on a bounded table of dense features, and isotonic calibration, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 3, 48, 0.15, 8, 1.0


@dataclass
class Boosted:
    """margin = bias + the sum over trees of the value of the leaf reached. A tree is complete: its inner nodes are (feature, cut) in
    level order, where a row goes right if its feature is above the cut."""

    bias: float
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        each = np.arange(len(rows))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[each, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def boost(rows: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic loss; trees of DEPTH levels on quantile bins. A node that can't be split sends all rows left."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Boosted(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for x in rows.T]
    bins = np.column_stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, rows.T)])
    margin, inner = np.full(len(y), model.bias), 2**DEPTH - 1
    for _ in range(TREES):
        p = sigmoid(margin)
        grad, hess = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            right = np.zeros(len(own), bool)
            if found := _best_split(bins[own], grad[own], hess[own], cuts):
                f, k = found
                feature[node], cut[node], right = f, cuts[f][k], bins[own, f] > k
            at[own] = 2 * node + 1 + right
        g, h = (np.bincount(at - inner, v, inner + 1) for v in (grad, hess))
        leaf = -RATE * g / (h + RIDGE)
        margin += leaf[at - inner]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaf)
        if np.abs(leaf).max() < 1e-4:
            break
    return model


def _best_split(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int] | None:
    """(feature, bin) of the greatest gain with LEAST rows on both sides; the first of equal ones."""
    if len(bins) < 2 * LEAST:
        return None
    g, h, best, found = grad.sum(), hess.sum(), 1e-6, None
    for f, c in enumerate(cuts):
        gs, hs, ns = (np.bincount(bins[:, f], v, len(c) + 1)[:-1].cumsum() for v in (grad, hess, None))
        gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
        gain[(ns < LEAST) | (len(bins) - ns < LEAST)] = 0
        if len(gain) and gain.max() > best * (1 + 1e-9):
            best, found = gain.max(), (f, int(gain.argmax()))
    return found


def isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margins, rates), rates not falling; numpy.interp between them calibrates a margin.

    A pooled block's rate is drawn to the common one as by ``prior`` more rows, so that few rows make no certainty.
    """
    common = float(y.mean())
    order = np.argsort(margin, kind="stable")
    x, first = np.unique(margin[order], return_index=True)
    n = np.diff(np.r_[first, len(y)]).astype(float)
    s = np.add.reduceat(y[order].astype(float), first)
    blocks: list[list[float]] = []  # rows, their ones, least and greatest margin
    for xi, ni, si in zip(x, n, s):
        blocks.append([ni, si, xi, xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            ni, si, _, hi = blocks.pop()
            blocks[-1][0] += ni
            blocks[-1][1] += si
            blocks[-1][3] = hi
    at = np.array([[b[2], b[3]] for b in blocks]).ravel()
    return at, np.maximum.accumulate(np.repeat([(b[1] + prior * common) / (b[0] + prior) for b in blocks], 2))
