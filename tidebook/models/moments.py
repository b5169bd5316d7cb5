"""Many regressions from one aggregation.

Least squares, ridge and lasso need only sums of products. For p columns that is a p x p
matrix per fold or split, summed by Spark in one map-side-combined pass; the driver then
solves these small systems, instead of fitting every fold over the data again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Moments:
    """Row count, column sums and product sums of (already shifted) columns; the label comes last."""

    def __init__(self, n: float, sums: np.ndarray, products: np.ndarray):
        self.n, self.sums, self.products = n, sums, products

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)

    def covariance(self) -> np.ndarray:
        mean = self.sums / self.n
        return self.products / self.n - np.outer(mean, mean)

    def fit(self, alpha: float = 0.0) -> tuple[np.ndarray, float]:
        """Weights and intercept; ``alpha`` > 0 adds the lasso penalty on the mean squared error / 2."""
        cov, mean = self.covariance(), self.sums / self.n
        a, b = cov[:-1, :-1], cov[:-1, -1]
        weights = np.linalg.lstsq(a, b, rcond=None)[0]
        if alpha > 0:
            weights = soft_descent(a, b, alpha)
        return weights, float(mean[-1] - weights @ mean[:-1])


def soft_descent(a: np.ndarray, b: np.ndarray, alpha: float, rounds: int = 10_000, tol: float = 1e-14) -> np.ndarray:
    """Coordinate descent for w'aw / 2 - b'w + alpha |w|."""
    w = np.zeros(len(b))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(b)):
            if a[j, j] > 0:
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / a[j, j]
        if np.abs(w - before).max() <= tol * max(1.0, np.abs(w).max()):
            break
    return w


def means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    return [float(v or 0.0) for v in df.agg(*[F.avg(c) for c in columns]).first()]


def moments_by(df: DataFrame, columns: Sequence[str], shift: Sequence[float], by: Column) -> dict[int, Moments]:
    """Moments per value of ``by`` (a few folds or splits). ``shift`` keeps the sums well scaled."""
    p = len(columns)
    moved = df.select(by.alias("by"), *[(F.col(c).cast("double") - F.lit(s)).alias(f"m{i}") for i, (c, s) in enumerate(zip(columns, shift))])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = moved.groupBy("by").agg(
        F.count(F.lit(1)), *[F.sum(f"m{i}") for i in range(p)], *[F.sum(F.col(f"m{i}") * F.col(f"m{j}")) for i, j in pairs]).collect()
    out = {}
    for by_value, n, *values in rows:
        products = np.zeros((p, p))
        for (i, j), value in zip(pairs, values[p:]):
            products[i, j] = products[j, i] = value
        out[by_value] = Moments(float(n), np.array(values[:p]), products)
    return out
