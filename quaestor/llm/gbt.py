"""Gradient-boosted trees for a bounded sample, scored by Arrow batches.

Training happens on the driver over at most a documented number of feature rows; scoring passes the feature columns
alone, never the texts, through an Arrow UDF.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    features: list[str]
    base: float
    trees: list
    a: float = 1.0
    b: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += _walk(t, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.margin(x) + self.b)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> Boosted:
        """Platt scaling of the margin on held-out labels; ridge and step halving keep a separable holdout finite."""
        scale = max(1e-6, float(np.abs(self.margin(x)).mean()))
        m = self.margin(x) / scale
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

        def loss(v: np.ndarray) -> float:
            z = v[0] * m + v[1]
            return float((np.logaddexp(0, z) - target * z).mean() + ridge / 2 * (v[0] - scale) ** 2 / scale**2)

        v = np.array([scale, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(v[0] * m + v[1], -50, 50)))
            g = np.array([((p - target) * m).mean() + ridge * (v[0] - scale) / scale**2, (p - target).mean()])
            w = p * (1 - p)
            h = np.array([[(w * m * m).mean() + ridge / scale**2, (w * m).mean()], [(w * m).mean(), w.mean()]]) + 1e-6 * np.eye(2)
            d, step = np.linalg.solve(h, g), 1.0
            while loss(v - step * d) > loss(v) and step > 1e-4:
                step /= 2
            v = v - step * d
        self.a, self.b = float(v[0] / scale), float(v[1])
        return self

    def column(self) -> Column:
        """The calibrated probability over the feature columns, by Arrow batches.

        Marked as nondeterministic so that no filter on it is pushed below the statistics, which would compute these anew."""
        model = self

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(model.probability(np.vstack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)

        return probability.asNondeterministic()(F.array(*[F.col(f).cast("double") for f in self.features]))


def _walk(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, cut, left, right = node
    return np.where(x[:, f] <= cut, _walk(left, x), _walk(right, x))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 2.0, least: int = 8) -> Boosted:
    """Logistic boosting with second-order leaves over quantile bins; ties are broken by the lower feature index."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, margin, out = float(np.log(p0 / (1 - p0))), np.full(len(y), float(np.log(p0 / (1 - p0)))), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(-rate * gs / (hs + l2))
        if level == 0 or len(rows) < 2 * least:
            return leaf
        best, where = 1e-6, None
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            k = len(c) + 1
            hg = np.bincount(code[rows, j], weights=g[rows], minlength=k).cumsum()[:-1]
            hh = np.bincount(code[rows, j], weights=h[rows], minlength=k).cumsum()[:-1]
            hn = np.bincount(code[rows, j], minlength=k).cumsum()[:-1]
            gain = hg**2 / (hh + l2) + (gs - hg) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
            gain[(hn < least) | (len(rows) - hn < least)] = -1
            i = int(gain.argmax())
            if gain[i] > best:
                best, where = gain[i], (j, i)
        if where is None:
            return leaf
        j, i = where
        left = code[rows, j] <= i
        return (j, float(cuts[j][i]), grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        out.append(tree)
        margin = margin + _walk(tree, x)
    return Boosted(names, base, out)
