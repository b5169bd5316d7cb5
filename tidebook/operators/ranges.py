"""Ranges of an order that hold about equally many rows, even where many rows agree in the first columns."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most ranges; one bound of each passes through the driver and is part of the plan.
MAX_RANGES = 100_000
# Sampled rows per range: sizes then vary by about an eighth.
SAMPLED = 60


def ranges_of(df: DataFrame, order: Sequence[str], rows_per_range: int, nulls_last: bool = False, n: int | None = None) -> tuple[Column, int]:
    """(number of the range from 0, how many ranges): at most about ``rows_per_range`` rows each, in the order of the columns.

    Rows are counted first, unless their number ``n`` is given, and a table that fits one range needs no more. Else bounds are taken
    from a sorted sample of whole order tuples, so rows with an equal first column are split by the next ones;
    only rows that agree in all of ``order`` stay together. NULLs come first; with ``nulls_last`` those
    of the (only) order column have a range of their own at the end.
    """
    n = df.count() if n is None else n
    if n <= rows_per_range:
        return F.lit(0), 1
    # Sizes vary, so ranges are aimed at a little over half of what is allowed.
    wanted = min(MAX_RANGES, math.ceil(n / (0.6 * rows_per_range)))
    picked = _bounds(df, list(order), n, wanted, nulls_last)
    number = _passed(df, list(order), picked)
    if nulls_last:
        number = F.when(F.col(order[0]).isNull(), len(picked) + 1).otherwise(number)
    return number.cast("int"), len(picked) + 1 + int(nulls_last)


def _bounds(df: DataFrame, order: list[str], n: int, wanted: int, nulls_last: bool) -> list[tuple]:
    """At most ``wanted`` - 1 order tuples, as text."""
    rows = df.select(*order)
    if nulls_last:
        rows = rows.where(F.col(order[0]).isNotNull())
    share = SAMPLED * wanted / n
    sample = (rows.sample(share, seed=1) if share < 1 else rows).withColumn("__at", F.lit(0))
    # The sample is bounded by SAMPLED x MAX_RANGES rows; every step-th of them leaves its task.
    step = max(1, round(min(n, SAMPLED * wanted) / wanted))
    sorted_rows = sample.repartition(1).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    found = sorted_rows.where((F.col("__at") % step == 0) & (F.col("__at") > 0)).select(*[F.col(c).cast("string") for c in order])
    return list(dict.fromkeys(tuple(r) for r in found.collect()))


def _passed(df: DataFrame, order: list[str], bounds: list[tuple]) -> Column:
    """How many bounds are at or below the row's order tuple, by halving; the bounds are constants of the plan."""
    if not bounds:
        return F.lit(0)
    columns = []
    for i, c in enumerate(order):
        text = F.from_json(F.lit(json.dumps([b[i] for b in bounds])), "array<string>")
        columns.append(text.cast(f"array<{df.schema[c].dataType.simpleString()}>"))

    def at_or_below(place: Column) -> Column:
        result = F.lit(True)
        for c, values in reversed(list(zip(order, columns))):
            bound, own = F.get(values, place), F.col(c)
            less = (bound.isNull() & own.isNotNull()) | F.coalesce(bound < own, F.lit(False))
            result = less | (bound.eqNullSafe(own) & result)
        return result

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        goes_up = (state["low"] < state["high"]) & at_or_below(middle)
        return F.struct(
            F.when(goes_up, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(goes_up | (state["low"] >= state["high"]), state["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(steps, start, halve, lambda s: s["low"])
