"""Join shapes the jobs share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_suffixes(df: DataFrame, column: str, suffixes: Sequence[str], out: str) -> DataFrame:
    """Each row once per suffix, in one scan."""
    names = F.array(*[F.concat(F.col(column), F.lit(s)) for s in suffixes])
    return df.select("*", F.explode(names).alias(out))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys in which NULL matches NULL, as groups do."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def day_spine(df: DataFrame, column: str, out: str = "day") -> DataFrame:
    """Every day between the first and the last date of ``column``."""
    ends = df.agg(F.min(column).cast("date").alias("lo"), F.max(column).cast("date").alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(out))


def spine_sum(df: DataFrame, column: str, value: str, out: str = "day") -> DataFrame:
    """Sum of ``value`` for every day of the range, 0 where there is none."""
    sums = df.groupBy(F.col(column).cast("date").alias(out)).agg(F.sum(value).alias(value))
    return day_spine(df, column, out).join(sums, out, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def in_keys(df: DataFrame, column: str, keys: DataFrame, extra: Sequence[int] = ()) -> DataFrame:
    """Rows whose ``column`` is in the first column of ``keys`` or in the ``extra`` constants."""
    allowed = keys.select(F.col(keys.columns[0]).cast("bigint").alias("__key"))
    if extra:
        more = df.sparkSession.createDataFrame([(int(v),) for v in extra], "__key bigint")
        allowed = allowed.union(more)
    return df.join(allowed, F.col(column) == F.col("__key"), "left_semi")
