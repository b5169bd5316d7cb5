"""Percentiles: a bounded sketch, and an exact form built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.joins import null_safe
from tidebook.operators.windows import running_sums
from tidebook.session import materialize

ACCURACY = 10_000
# A group's sketch gives this many marks; a wanted rank lies between two of them, a few marks apart.
MARKS = 400
# Groups whose brackets (some 100 bytes per percentile) are sent to all tasks; more are joined.
BROADCAST_GROUPS = 20_000


def approx_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Columns ``p0, p1, ..``: one mergeable sketch per group, rank error at most n / accuracy."""
    found = F.percentile_approx(value, list(qs), accuracy)
    return df.groupBy(*keys).agg(found.alias("__p")).select(*keys, *[F.col("__p")[i].alias(f"p{i}") for i in range(len(qs))])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles per group, columns ``p0, p1, ..`` (NULL skipped).

    ``percentile`` holds every distinct value of a group in one task. Here a sketch per group,
    whose rank error is bounded, gives a bracket that holds each wanted rank. Rows below the
    bracket are only counted, where they lie; the distinct values inside it (about four marks
    in ``MARKS``) are ordered in ranges. Groups of every size go this way.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    n = F.col("__n")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", [i / MARKS for i in range(MARKS + 1)], ACCURACY).alias("__marks"),
    )
    slack = 2.0 * MARKS / ACCURACY

    def wanted(i: int, q: float) -> Column:
        rank = F.lit(float(q)) * (n - 1)
        low = F.floor((F.floor(rank) + 1) / n * MARKS - slack).cast("int") - 1
        high = F.ceil((F.ceil(rank) + 1) / n * MARKS + slack).cast("int") + 1
        return F.struct(
            F.lit(i).alias("i"), rank.alias("rank"),
            F.when(low < 0, F.col("__min")).otherwise(F.get("__marks", low)).alias("lo"),
            F.when(high > MARKS, F.col("__max")).otherwise(F.get("__marks", high)).alias("hi"),
        )

    brackets = stats.select(*keys, F.array(*[wanted(i, q) for i, q in enumerate(qs)]).alias("__want")).where(n > 0)
    joined = _attach(rows, brackets, keys).select(*keys, "__v", F.explode("__want").alias("w"))
    # One row per distinct value inside a bracket; everything below it collapses to one row.
    counted = materialize(
        joined.where(F.col("__v") <= F.col("w.hi"))
        .select(*keys, F.col("w.i").alias("i"), F.col("w.rank").alias("rank"), F.when(F.col("__v") >= F.col("w.lo"), F.col("__v")).alias("__v"))
        .groupBy(*keys, "i", "rank", "__v")
        .agg(F.count(F.lit(1)).alias("__c")), "counted")
    ranked = running_sums(counted, {"__end": ([*keys, "i"], F.col("__c"))}, ["__v"])
    start = F.col("__end") - F.col("__c")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < F.col("__end")), F.col("__v")))

    picked = ranked.groupBy(*keys, "i").agg(
        at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"),
        F.max(F.col("rank") - F.floor("rank")).alias("part"),
    )
    answer = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + F.col("part") * (F.col("b") - F.col("a")))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, answer)).alias(f"p{i}") for i in range(len(qs))])


def _attach(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return rows.withColumn("__want", brackets.select("__want").scalar())
    brackets = materialize(brackets, "brackets")
    few = brackets.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return null_safe(rows, F.broadcast(brackets) if few else brackets, keys)
