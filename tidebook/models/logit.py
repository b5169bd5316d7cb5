"""Logistic regression by Newton steps: one p x p aggregation over the rows per step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.models import moments
from tidebook.session import materialize


@dataclass
class Logit:
    """Weights of a fitted model; ``gradient`` is the largest slope of the penalised loss that was left, ``passes`` counts the scans."""

    features: list[str]
    weights: list[float]
    intercept: float
    loss: float
    gradient: float
    passes: int

    def margin(self) -> Column:
        return _line([F.col(f).cast("double") for f in self.features], self.weights, self.intercept)

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))

    def table(self, df: DataFrame) -> DataFrame:
        """One row per feature and the intercept."""
        rows = [*zip(self.features, self.weights), ("intercept", self.intercept)]
        return df.sparkSession.createDataFrame(rows, "feature string, weight double")


def _line(columns: Sequence[Column], weights: Sequence[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for column, weight in zip(columns, weights):
        out = out + F.lit(float(weight)) * column
    return out


def _sums(rows: DataFrame, p: int, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, slope and curvature at ``w`` (intercept first), without the penalty."""
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(p)]]
    z, y = _line(x[1:], w[1:], w[0]), F.col("y")
    stepped = rows.withColumn("z", z).withColumn("q", 1.0 / (1.0 + F.exp(-F.col("z"))))
    gap, spread = F.col("q") - y, F.col("q") * (1.0 - F.col("q"))
    loss = F.sum(F.greatest(F.col("z"), F.lit(0.0)) - y * F.col("z") + F.log1p(F.exp(-F.abs("z"))))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    found = stepped.agg(loss, *[F.sum(gap * c) for c in x], *[F.sum(spread * x[i] * x[j]) for i, j in pairs]).first()
    curve = np.zeros((p + 1, p + 1))
    for (i, j), value in zip(pairs, found[p + 2 :]):
        curve[i, j] = curve[j, i] = value
    return float(found[0]), np.array(found[1 : p + 2]), curve


def fit(df: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0, passes: int = 60, tol: float = 1e-9) -> Logit:
    """Minimises the summed logistic loss + penalty / 2 * |weights|^2; the intercept is not penalised.

    Rows with a NULL are left out. Every step is one aggregation whose size depends on the number
    of features only; a step that does not lower the loss is halved, so fits of nearly separable
    labels settle too. ``label`` is 0 / 1.
    """
    p = len(features)
    columns = [*features, label]
    shift = moments.means(df.dropna(subset=columns), features) if p else []
    rows = materialize(df.dropna(subset=columns).select(
        *[(F.col(c).cast("double") - F.lit(s)).alias(f"x{i}") for i, (c, s) in enumerate(zip(features, shift))], F.col(label).cast("double").alias("y")), "logit")
    if rows.isEmpty():
        return Logit(list(features), [0.0] * p, 0.0, 0.0, 0.0, 1)
    ridge = np.diag([0.0, *[penalty] * p])
    w = best = np.zeros(p + 1)
    lowest, slope, step = np.inf, None, None
    for done in range(1, passes + 1):
        loss, slope_here, curve = _sums(rows, p, w)
        loss += w @ ridge @ w / 2
        if loss <= lowest + 1e-12 * max(1.0, abs(lowest)):
            lowest, best, slope = loss, w, slope_here + ridge @ w
            if np.abs(slope).max() <= tol:
                break
            step = np.linalg.lstsq(curve + ridge, slope, rcond=None)[0]
        else:
            step = step / 2
        w = best - step
        if np.abs(step).max() <= 1e-15 * max(1.0, np.abs(best).max()):
            break
    weights = [float(v) for v in best[1:]]
    return Logit(list(features), weights, float(best[0] - np.dot(best[1:], shift)), float(lowest), float(np.abs(slope).max()), done)
