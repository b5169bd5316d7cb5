"""Stored percentile sketches: one small row per key and day, merged over any span without the raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sketch size: with 2,048 the rank error is below a fifth of a per cent in 99 of 100 cases, and
# groups of fewer values are exact. A sketch takes some 30 KB at most.
SIZE = 2048
# What callers may rely on.
RANK_ERROR = 0.01


def day_sketches(df: DataFrame, keys: Sequence[str], at: str, value: str, size: int = SIZE) -> DataFrame:
    """(keys, day, cnt, sketch) of the known values; sketches are combined before the shuffle, so hot keys send one row per task."""
    rows = df.select(*keys, F.to_date(at).alias("day"), F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    return rows.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("cnt"), F.kll_sketch_agg_double("__v", F.lit(size)).alias("sketch"))


def span_sketches(stored: DataFrame, keys: Sequence[str], start: str | None = None, end: str | None = None, size: int = SIZE) -> DataFrame:
    """(keys, cnt, sketch) of the days ``start`` <= day < ``end``, from stored sketches only."""
    days = stored
    if start is not None:
        days = days.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.where(F.col("day") < F.lit(end).cast("date"))
    return days.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def percentiles(sketches: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """(keys, cnt, p0, p1, ..): the value at each share of the rows, in the order of ``qs``."""
    return sketches.select(*keys, "cnt", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{i}") for i, q in enumerate(qs)])


def _miss(q: float, answer: Column, value: Column) -> Column:
    """How far share ``q`` is from the ranks that ``answer`` has among the values."""
    below = F.avg((value < answer).cast("double"))
    up_to = F.avg((value <= answer).cast("double"))
    return F.greatest(below - q, F.lit(q) - up_to, F.lit(0.0))


def rank_errors(df: DataFrame, keys: Sequence[str], value: str, answers: DataFrame, qs: Sequence[float]) -> DataFrame:
    """(keys, n, error): the largest rank error of ``answers`` (columns p0, p1, ..), measured against all rows in one pass."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    joined = rows.join(answers.drop("cnt"), list(keys))
    misses = [_miss(q, F.col(f"p{i}"), F.col("__v")) for i, q in enumerate(qs)]
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.greatest(*misses, F.lit(0.0)).alias("error"))
