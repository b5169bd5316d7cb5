"""Least squares, lasso and ridge."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.models import moments
from tidebook.operators.sampling import hash_below, hash_order, hash_share


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def linear(df: DataFrame, features: Sequence[str], label: str) -> LinearRegressionModel:
    """Ordinary least squares: one pass over the data (normal equations)."""
    return LinearRegression(labelCol=label, regParam=0.0, solver="normal").fit(assemble(df, features))


def lasso(df: DataFrame, features: Sequence[str], label: str, alpha: float) -> LinearRegressionModel:
    """Minimises squared error / 2n + alpha * |w|, on unscaled features."""
    estimator = LinearRegression(labelCol=label, elasticNetParam=1.0, regParam=alpha, standardization=False, solver="normal", maxIter=500, tol=1e-12)
    return estimator.fit(assemble(df, features))


def ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> LinearRegressionModel:
    """Minimises squared error + alpha * |w|^2, on unscaled features.

    Spark divides the error by n and scales the penalty by the label's deviation.
    """
    n, deviation = df.agg(F.count(label), F.stddev_pop(label)).first()
    estimator = LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=alpha * deviation / n, standardization=False, solver="normal")
    return estimator.fit(assemble(df, features))


def ridge_classifier(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> LinearRegressionModel:
    """Ridge on labels -1 / +1; the sign of the prediction is the class."""
    return ridge(df.withColumn("__side", F.col(label) * 2.0 - 1.0), features, "__side", alpha)


def predicted(model: LinearRegressionModel, features: Sequence[str]) -> Column:
    """The fitted line as a column expression, so scoring needs no vectors."""
    out = F.lit(float(model.intercept))
    for weight, name in zip(model.coefficients, features):
        out = out + F.lit(float(weight)) * F.col(name)
    return out


def coefficients(model: LinearRegressionModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """The fitted weights as a table (one row per feature and the intercept)."""
    rows = [(n, float(w)) for n, w in zip(features, model.coefficients)] + [("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double")


def subgradients(df: DataFrame, features: Sequence[str], label: str, alpha: float, model: LinearRegressionModel) -> DataFrame:
    """How far a lasso fit is from its optimality conditions, per feature, in one pass.

    The slope of the squared error / 2n must be alpha against the sign of an ``active`` weight and at most alpha in size
    for a zero one; ``excess`` is what is missing, as a share of the feature's own deviation.
    """
    columns = [*features, label]
    shift = moments.means(df, columns)
    cov = moments.moments_by(df, columns, shift, F.lit(0))[0].covariance()
    weights = np.array([float(w) for w in model.coefficients])
    slopes = cov[:-1, -1] - cov[:-1, :-1] @ weights
    size = np.sqrt(np.maximum(np.diag(cov)[:-1], 1e-300))
    excess = np.where(weights != 0, np.abs(slopes - alpha * np.sign(weights)), np.maximum(np.abs(slopes) - alpha, 0.0)) / size
    rows = [(f, float(w), bool(w != 0), float(s), float(e)) for f, w, s, e in zip(features, weights, slopes, excess)]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double, active boolean, slope double, excess double")


def feature_rmse(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Training error of each one-feature regression, all in one aggregation."""
    def rmse(c: str) -> Column:
        explained = F.pow(F.regr_sxy(target, c), 2) / F.nullif(F.regr_sxx(target, c), F.lit(0.0))
        return F.sqrt((F.regr_syy(target, c) - F.coalesce(explained, F.lit(0.0))) / F.regr_count(target, c))

    one = df.agg(*[rmse(c).alias(c) for c in features])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("rmse")) for c in features])
    return one.select(F.inline(cells))


def _gap(features: Sequence[str], shift: Sequence[float], label: str, prefix: str) -> Column:
    """Label minus the line whose weights lie in columns ``{prefix}_0, ..`` (intercept last)."""
    line = F.col(f"{prefix}_{len(features)}")
    for i, (c, s) in enumerate(zip(features, shift)):
        line = line + F.col(f"{prefix}_{i}") * (F.col(c) - F.lit(s))
    return F.col(label) - F.lit(shift[-1]) - line


def _weight_table(df: DataFrame, key: str, rows: dict[int, list[float]], names: Sequence[str]) -> DataFrame:
    """One row of fitted weights per fold or split (a few dozen), to join on ``key``."""
    schema = ", ".join([f"{key} int", *[f"{n} double" for n in names]])
    table = df.sparkSession.createDataFrame([(k, *map(float, values)) for k, values in rows.items()], schema)
    return F.broadcast(table)


def cross_validate(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 7, seed: int = 1) -> DataFrame:
    """Mean absolute and squared error of least squares per fold; folds come from a hash of ``key``.

    Three passes whatever ``k``: means, sums of products per fold, errors.
    """
    fold = F.floor(hash_share(seed, key) * k).cast("int")
    columns = [*features, label]
    shift = moments.means(df, columns)
    folds = moments.moments_by(df, columns, shift, fold)
    total = sum(folds.values(), moments.Moments(0.0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))))
    fitted = {}
    for f, held_out in folds.items():
        weights, intercept = (total - held_out).fit()
        fitted[f] = [*weights, intercept]
    table = _weight_table(df, "fold", fitted, [f"w_{i}" for i in range(len(columns))])
    gap = _gap(features, shift, label, "w")
    return df.withColumn("fold", fold).join(table, "fold").groupBy("fold").agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))


def grid_search(df: DataFrame, features: Sequence[str], label: str, key: str, alphas: Sequence[float], splits: int = 30, test_share: float = 0.2, seed: int = 12) -> DataFrame:
    """Mean absolute error of the lasso for every alpha over repeated hash-seeded splits.

    Four passes for all splits and alphas. A row is repeated only for the splits that test
    on it; the training sums of a split are the total less its test rows.
    """
    columns = [*features, label]
    shift = moments.means(df, columns)
    total = moments.moments_by(df, columns, shift, F.lit(0))[0]
    # A digest decides four splits; exploding the digests computes each once.
    digests = F.array(*[hash_order(seed + d, key) for d in range((splits + 3) // 4)])
    words = F.array(*[F.when(hash_below(test_share, F.col("digest"), w), F.col("d") * 4 + w) for w in range(4)])
    tested = (
        df.select(*columns, F.posexplode(digests).alias("d", "digest"))
        .select(*columns, F.explode(F.array_compact(words)).alias("split"))
        .where(F.col("split") < splits)
    )
    fitted = {}
    for i, held_out in moments.moments_by(tested, columns, shift, F.col("split")).items():
        fits = [(total - held_out).fit(a) for a in alphas]
        fitted[i] = [v for weights, intercept in fits for v in (*weights, intercept)]
    names = [f"a{a}_{i}" for a in range(len(alphas)) for i in range(len(columns))]
    scored = tested.join(_weight_table(df, "split", fitted, names), "split")
    errors = scored.groupBy("split").agg(*[F.avg(F.abs(_gap(features, shift, label, f"a{a}"))).alias(f"e{a}") for a in range(len(alphas))])
    cells = F.array(*[F.struct(F.lit(float(alpha)).alias("alpha"), F.col(f"e{a}").alias("mae")) for a, alpha in enumerate(alphas)])
    return errors.select(F.inline(cells)).groupBy("alpha").agg(F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("splits"))
