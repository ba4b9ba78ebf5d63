"""Gradient-boosted trees with monotonic constraints, flattened into numpy node arrays.

A model is a few arrays: for tree ``t`` of depth ``d``, inner node ``i`` (children ``2i + 1`` and ``2i + 2``) tests
``x[feature[t, i]] <= threshold[t, i]``; ``leaf[t]`` has the 2**d leaf values.  Scoring walks all rows of a batch through
one tree level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray  # int32 [trees, 2**depth - 1]
    threshold: np.ndarray  # float64, same shape; +inf sends every row left
    leaf: np.ndarray  # float64 [trees, 2**depth]
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for rows of features; NaN goes left."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Candidate thresholds per feature: midpoints of its quantiles."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
        ridge: float = 5.0, least_rows: int = 20) -> Trees:
    """Fit P(y = 1) by Newton boosting of the logistic loss.

    ``directions[f]`` is +1 or -1 where the score may only rise or fall with feature ``f``, else 0.  A split on such a feature
    needs child values in that order, and its subtrees are held to either side of the children's middle, so the
    whole model is monotonic.
    """
    edges = _edges(x)
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]) if len(edges) else x
    n_features, inner = x.shape[1], (1 << depth) - 1
    rate_of_ones = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)),
                  float(np.log(rate_of_ones / (1 - rate_of_ones))))
    margin = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        bounds = {0: (-np.inf, np.inf)}
        value = {0: float(grad.sum() / (hess.sum() + ridge))}
        for i in range(inner):
            low, high = bounds[i]
            rows = np.flatnonzero(node == i)
            best = None
            if len(rows) >= 2 * least_rows:
                g, h = grad[rows], hess[rows]
                total_g, total_h = g.sum(), h.sum()
                for f in range(n_features):
                    n = len(edges[f]) + 1
                    if n == 1:
                        continue
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (g, h, np.ones(len(rows))))
                    left = np.clip(gl / (hl + ridge), low, high)
                    right = np.clip((total_g - gl) / (total_h - hl + ridge), low, high)
                    gain = (gl * left - 0.5 * (hl + ridge) * left ** 2
                            + (total_g - gl) * right - 0.5 * (total_h - hl + ridge) * right ** 2)
                    allowed = (nl >= least_rows) & (len(rows) - nl >= least_rows) & (directions[f] * (right - left) >= 0)
                    if allowed.any():
                        at = int(np.argmax(np.where(allowed, gain, -np.inf)))
                        if best is None or gain[at] > best[0] + 1e-12:
                            best = (gain[at], f, at, left[at], right[at])
            here = value[i]
            if best is not None and best[0] > total_g * here - 0.5 * (total_h + ridge) * here ** 2 + 1e-9:
                _, f, at, left, right = best
                model.feature[t, i], model.threshold[t, i] = f, edges[f][at]
                goes_right = binned[rows, f] > at
                middle = (left + right) / 2
                bounds[2 * i + 1] = (low, min(high, middle)) if directions[f] > 0 else (max(low, middle), high) if directions[f] < 0 else (low, high)
                bounds[2 * i + 2] = (max(low, middle), high) if directions[f] > 0 else (low, min(high, middle)) if directions[f] < 0 else (low, high)
                value[2 * i + 1], value[2 * i + 2] = float(left), float(right)
                node[rows] = 2 * i + 1 + goes_right
            else:
                node[rows] = 2 * i + 1
                bounds[2 * i + 1] = bounds[2 * i + 2] = bounds[i]
                value[2 * i + 1] = value[2 * i + 2] = here
        for k in range(inner + 1):
            model.leaf[t, k] = rate * value[inner + k]
        margin += model.leaf[t][node - inner]
    return model
