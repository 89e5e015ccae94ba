"""Decision trees on binned features (numpy), shared by the rule ensemble and the forest."""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    """Cut points between distinct quantiles of every column."""
    edges = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        edges.append((q[1:] + q[:-1]) / 2)
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]) if len(edges) else np.zeros((len(x), 0), int)


def grow(b: np.ndarray, y: np.ndarray, edges: list[np.ndarray], depth: int, rng, features: int, least: int):
    """A regression tree for y by variance reduction: nested (feature, cut, left, right) or a leaf's mean.

    ``cut`` sends x <= cut to the left. Every node looks at ``features`` columns
    drawn at random; leaves hold ``least`` rows or more.
    """
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return float(y.mean()) if len(y) else 0.0
    best = (1e-9, None, None)
    for f in rng.permutation(b.shape[1])[:features]:
        n_bins = len(edges[f]) + 1
        if n_bins < 2:
            continue
        n = np.cumsum(np.bincount(b[:, f], minlength=n_bins))[:-1]
        s = np.cumsum(np.bincount(b[:, f], weights=y, minlength=n_bins))[:-1]
        ok = (n >= least) & (len(y) - n >= least)
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(y) - n, 1) - y.sum() ** 2 / len(y), 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] is None:
        return float(y.mean())
    left = b[:, best[1]] <= best[2]
    go = [grow(b[side], y[side], edges, depth - 1, rng, features, least) for side in (left, ~left)]
    return (int(best[1]), float(edges[best[1]][best[2]]), *go)


def evaluate(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    side = x[:, f] <= cut
    out = np.empty(len(x))
    out[side] = evaluate(left, x[side])
    out[~side] = evaluate(right, x[~side])
    return out


def paths(tree, conditions=()) -> list[tuple]:
    """Every node but the root as a tuple of (feature, "<=" or ">", cut)."""
    if not isinstance(tree, tuple):
        return []
    f, cut, left, right = tree
    out = []
    for sign, branch in (("<=", left), (">", right)):
        rule = (*conditions, (f, sign, cut))
        out += [rule, *paths(branch, rule)]
    return out


def simplify(rule: tuple) -> tuple:
    """One bound for each feature and side, in order."""
    tight: dict = {}
    for f, sign, cut in rule:
        old = tight.get((f, sign), cut)
        tight[f, sign] = min(old, cut) if sign == "<=" else max(old, cut)
    return tuple(sorted((f, sign, cut) for (f, sign), cut in tight.items()))


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, cut in rule:
        out &= (x[:, f] <= cut) if sign == "<=" else (x[:, f] > cut)
    return out
