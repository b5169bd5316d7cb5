"""Cleaning steps: ordered overwrites, caps, sentinels, fills, outlier cuts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.windows import row_index


def masked_assign(assignments: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Ordered conditional overwrite: a later assignment wins, so the CASE runs backwards."""
    (condition, value), *rest = reversed(list(assignments))
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def clip_upper(column: Column, limit: float) -> Column:
    """NULL stays NULL (``least`` would skip it)."""
    return F.when(column > limit, F.lit(limit)).otherwise(column)


def sentinel_to_max(df: DataFrame, column: str, floor: Column) -> DataFrame:
    """Values below ``floor`` become the column's maximum."""
    return df.withColumn(column, F.when(F.col(column) < floor, df.agg(F.max(column)).scalar()).otherwise(F.col(column)))


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means.select(c).scalar()) for c in columns})


def zscore_filter(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    stats = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    score = (F.col(column) - stats.select("m").scalar()) / F.nullif(stats.select("s").scalar(), F.lit(0.0))
    return df.where(F.abs(score) < limit)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes 0."""
    stats = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])

    def scaled(c: str) -> Column:
        mean, std = stats.select(f"{c}_m").scalar(), stats.select(f"{c}_s").scalar()
        return (F.col(c) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return df.withColumns({c: scaled(c) for c in columns})


def minmax(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Scale to 0..1 by the range of ``fitted_on`` (default ``df``); a constant column becomes 0."""
    source = fitted_on if fitted_on is not None else df
    stats = source.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        lo, hi = stats.select(f"{c}_lo").scalar(), stats.select(f"{c}_hi").scalar()
        return (F.col(c) - lo) / F.when(hi == lo, F.lit(1.0)).otherwise((hi - lo).cast("double"))

    return df.withColumns({c: scaled(c) for c in columns})


def one_hot(df: DataFrame, column: str, values: Mapping[str, object]) -> DataFrame:
    """0/1 columns, named by the keys of ``values``."""
    return df.withColumns({name: F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for name, v in values.items()})


def factorize(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Number the categories 0, 1, .. by their first appearance in the unique ``order``; NULL becomes -1."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__cat")).agg(F.min(order).alias("__first"))
    codes = row_index(first, "__first", out).select("__cat", out)
    joined = df.join(codes, F.col(column) == F.col("__cat"), "left").drop("__cat")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
