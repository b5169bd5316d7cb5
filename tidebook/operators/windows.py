"""Ordered computations that stay distributed when one key holds much of the data.

A plain window sends every row of a key to one task. Here keys are counted in ``BUCKETS`` hash
buckets. A bucket of at most ``ROWS_PER_RANGE`` rows is a single range. The rows of all others
are cut into ranges of the order columns that hold at most about that many, so no key has more
rows than that in one range, and rows are shuffled on (keys, range). One summary row per key
and range goes through the per-key window, and comes back as an "opening" row at the head of
its range. Rows whose keys are in a small bucket need none of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.joins import null_safe
from tidebook.operators.ranges import ranges_of
from tidebook.session import materialize

_RANGE, _BODY = "__range", "__body"
ROWS_PER_RANGE = 2_000_000
BUCKETS = 8_192


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _ranged(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """Rows with their range, and whether there is more than one.

    With ``keys`` only the rows of large buckets are cut; the others are in range -1.
    """
    if not keys:
        number, count = ranges_of(df, order, ROWS_PER_RANGE)
        return df.withColumns({_RANGE: number, _BODY: F.lit(1)}), count > 1
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    sizes = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_RANGE).collect()
    number, count = F.lit(-1), 1
    if sizes:
        large = bucket.isin([r.b for r in sizes])
        cut, count = ranges_of(df.where(large), order, ROWS_PER_RANGE, n=sum(r.n for r in sizes))
        number = F.when(large, cut).otherwise(number)
    return df.withColumns({_RANGE: number, _BODY: F.lit(1)}), count > 1


def running_sums(
    df: DataFrame, sums: Mapping[str, tuple[Sequence[str], Column]], order: Sequence[str], frame: str = "rows"
) -> DataFrame:
    """Add running sums: ``{output: (partition keys, value)}``.

    ``frame="range"`` lets rows with equal order values share the total: these are summed first,
    so any number of them is one row, and get the total by a join. ``"rows"`` does not,
    so end ``order`` in a unique key. Sums of DOUBLE depend on the order of addition, as
    always; use decimals where last digits matter. When the partition keys of one sum are
    contained in those of the others, all windows share one shuffle.
    """
    if frame == "range":
        result = df
        for out, (keys, value) in sums.items():
            at = [*keys, *order]
            peers = materialize(df.groupBy(*at).agg(F.sum(value).alias("__peers")), "peers")
            totals = running_sums(peers, {out: (keys, F.col("__peers"))}, order).select(*at, out)
            result = null_safe(result, totals, at)
        return result
    values = {out: f"__v{i}" for i, out in enumerate(sums)}
    all_keys = list(dict.fromkeys(k for keys, _ in sums.values() for k in keys))
    result, many = _ranged(df, order, [k for k in all_keys if all(k in keys for keys, _ in sums.values())])
    moved = {out: value for out, (_, value) in sums.items()}
    if many:
        # One map-side-combined pass gives the totals of every sum; coarser keys re-add the finer ones.
        fine = result.where(F.col(_RANGE) >= 0).groupBy(*all_keys, _RANGE).agg(*[F.sum(moved[out]).alias(v) for out, v in values.items()])
        openings = []
        for out, (keys, _) in sums.items():
            before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
            totals = fine.groupBy(*keys, _RANGE).agg(F.sum(values[out]).alias("__t"))
            openings.append(
                totals.select(*keys, _RANGE, F.lit(0).alias(_BODY), F.sum("__t").over(before).alias("__t"))
                .where(F.col("__t").isNotNull())
                .withColumnRenamed("__t", values[out])
            )
        result = _stack([result, *openings])
        # A row's own value is not moved beside the column that it comes from.
        moved = {out: F.when(F.col(_BODY) == 1, value).otherwise(F.col(values[out])) for out, value in moved.items()}
    for out, (keys, _) in sums.items():
        window = Window.partitionBy(*keys, *([_RANGE] if many else [])).orderBy(_BODY, *order)
        result = result.withColumn(out, F.sum(moved[out]).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return result.where(F.col(_BODY) == 1).drop(_RANGE, _BODY, *values.values())


def conditional_event_counter(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, out: str) -> DataFrame:
    """A counter per key that steps up by one on every row where ``condition`` holds."""
    step = F.coalesce(condition, F.lit(False)).cast("bigint")
    return running_sums(df, {out: (keys, step)}, order)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per key; the last value of a range is handed to the next one."""
    body, many = _ranged(df, order, keys)
    if many:
        last = body.where(F.col(_RANGE) >= 0).groupBy(*keys, _RANGE).agg(F.max_by(value, F.struct(*order)).alias("__last"))
        by_range = Window.partitionBy(*keys).orderBy(_RANGE)
        opening = last.withColumn(value, F.lag("__last").over(by_range)).withColumn(_BODY, F.lit(0)).drop("__last")
        body = _stack([body, opening])
    window = Window.partitionBy(*keys, *([_RANGE] if many else [])).orderBy(_BODY, *order)
    return body.withColumn(out, F.lag(value).over(window)).where(F.col(_BODY) == 1).drop(_RANGE, _BODY)


def repeated_value_streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, wanted: str) -> DataFrame:
    """Per key: how often ``wanted`` follows directly on ``wanted`` (``max_incidents``).

    The running count of such rows never falls, so its maximum is the total; inside a range
    it needs a lag, across ranges only the first and last value of each.
    """
    body, _ = _ranged(df, order, keys)
    window = Window.partitionBy(*keys, _RANGE).orderBy(*order)
    hit = (F.col(value) == F.lit(wanted)) & (F.col("__prev") == F.lit(wanted))
    per_range = (
        body.withColumn("__prev", F.lag(value).over(window))
        .groupBy(*keys, _RANGE)
        .agg(
            F.count_if(hit).alias("inside"),
            F.min_by(value, F.struct(*order)).alias("first"),
            F.max_by(value, F.struct(*order)).alias("last"),
        )
    )
    seam = (F.col("first") == F.lit(wanted)) & (F.lag("last").over(Window.partitionBy(*keys).orderBy(_RANGE)) == F.lit(wanted))
    return (
        per_range.withColumn("seam", F.coalesce(seam, F.lit(False)).cast("bigint"))
        .groupBy(*keys)
        .agg(F.sum(F.col("inside") + F.col("seam")).alias("max_incidents"))
    )


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row numbered 1 per key. An aggregate, so each task keeps one row per key before the shuffle."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns])


def row_index(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """Dense position 0..n-1 in the order of a unique ``key`` (NULL last), without one global sort task."""
    number, _ = ranges_of(df, [key], ROWS_PER_RANGE, nulls_last=True)
    body = df.withColumn(_RANGE, number)
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = body.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("__n")).select(_RANGE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(_RANGE).orderBy(F.col(key).asc_nulls_last()))
    return (
        body.withColumn("__local", inside)
        .join(F.broadcast(starts), _RANGE)  # one row per range
        .withColumn(out, F.col("__start") + F.col("__local") - 1)
        .drop(_RANGE, "__local", "__start")
    )
