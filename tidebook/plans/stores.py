"""Store table: cleaning and correlation with the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators import clean
from tidebook.operators.aggregates import corr_with


def clean_stores(df: DataFrame, fill: dict, mean_columns: Sequence[str], patch: tuple[str, object, str], cut: str) -> DataFrame:
    """Constant fills, one cell blanked by key, mean fills, then the 3-sigma cut on ``cut``.

    ``patch`` is (key column, key, column to blank).
    """
    key, value, column = patch
    rows = df.fillna(fill) if fill else df
    rows = rows.withColumn(column, F.when(F.col(key) == value, None).otherwise(F.col(column)))
    return clean.zscore_filter(clean.fill_mean(rows, mean_columns), cut)


def target_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    return corr_with(df, features, target)
