"""Aggregations: newest version, frequency tables, histograms, long statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.joins import null_safe
from tidebook.operators.percentiles import exact_percentiles
from tidebook.session import materialize


def newest(value: str | Column, *order: str) -> Column:
    """The non-NULL ``value`` of the highest ``order``; rows with a NULL value are skipped.

    End ``order`` in a column that tells versions of one time apart, the same for all values
    of a row: otherwise tied versions are picked at random, and each value on its own. A single
    number or time keeps the aggregation hashed.
    """
    v = F.col(value) if isinstance(value, str) else value
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return F.max_by(v, F.when(v.isNotNull(), rank))


def latest_per_day(df: DataFrame, key: str, updated: str, tie: str, values: Sequence[str]) -> DataFrame:
    day = F.to_date(updated).alias("updated_day")
    return df.groupBy(key, day).agg(*[newest(v, updated, tie).alias(v) for v in values])


def value_counts(df: DataFrame, *keys: str, out: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), *keys)


def histogram(df: DataFrame, value: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the whole range of ``value``; the last bin is closed on the right.

    One pass finds the range, one map-side-combined pass counts. Empty bins are left out.
    """
    # NaN counts as missing, as NULL does; infinite values have no bin either.
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("abs(__v) < double('inf')")
    bounds = rows.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    bin_no = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("__v") - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return rows.groupBy(*by, bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, the 1.5 IQR fences and the number of values outside them."""
    by = list(by)
    quartiles = exact_percentiles(df, by, value, [0.25, 0.5, 0.75])
    iqr = F.col("p2") - F.col("p0")
    fences = quartiles.select(
        *by, F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3"),
        (F.col("p0") - 1.5 * iqr).alias("low_fence"), (F.col("p2") + 1.5 * iqr).alias("high_fence"),
    )
    names = ["q1", "median", "q3", "low_fence", "high_fence"]
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    if by:
        joined = null_safe(rows, fences, by)
    else:
        joined = rows.withColumn("__f", fences.select(F.struct(*names)).scalar()).select("__v", "__f.*")
    outside = (F.col("__v") < F.col("low_fence")) | (F.col("__v") > F.col("high_fence"))
    return joined.groupBy(*by, *names).agg(F.count_if(outside).alias("outliers"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form: every pair in one aggregation pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(cells))


def corr_with(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    one = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns])
    return one.select(F.inline(cells)).orderBy("corr")


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: count, nulls, mean, sample std, min, quartiles, max."""
    long = unpivot(df, [], columns)
    simple = long.groupBy("variable").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(long, ["variable"], "value", [0.25, 0.5, 0.75])
    return simple.join(quartiles.toDF("variable", "q25", "q50", "q75"), "variable")


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def class_stats(df: DataFrame, columns: Sequence[str], label: str, all_label: str = "all") -> DataFrame:
    """Mean, median and sample std of each column, for the whole table and per class (long form)."""
    long = unpivot(df.select(F.col(label).cast("string").alias("class"), *columns), ["class"], columns)
    both = long.select(F.explode(F.array(F.lit(all_label), F.col("class"))).alias("class"), "variable", "value")
    stats = both.groupBy("class", "variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    median = exact_percentiles(both, ["class", "variable"], "value", [0.5]).withColumnRenamed("p0", "median")
    wide = null_safe(stats, median, ["class", "variable"])
    cells = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in ("mean", "median", "std")])
    return wide.select("class", "variable", F.inline(cells))


def pivot_sum(df: DataFrame, index: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """``names`` are the wanted columns; giving them saves Spark a pass to find the distinct values.

    A value that is not among them is an error, not a lost column.
    """
    known = F.col(column).isNull() | F.col(column).isin(*names)
    unknown = F.raise_error(F.concat(F.lit("not among the pivot columns: "), F.col(column).cast("string"))).cast(df.schema[column].dataType)
    df = df.withColumn(column, F.when(known, F.col(column)).otherwise(unknown))
    return df.groupBy(index).pivot(column, list(names)).agg(F.sum(value)).fillna(0)


def top_with_ties(df: DataFrame, score: str) -> DataFrame:
    """All rows whose ``score`` equals the maximum (none if every score is NULL).

    The maximum is one number, and a filter on it keeps tied rows where they are, however many.
    Scores are stored, as both passes need them.
    """
    df = materialize(df, "scores")
    top = df.agg(F.max(score).alias(score)).select(score).scalar()
    return df.where(F.col(score) == top)


def agree_share(df: DataFrame, models: Mapping[str, str]) -> DataFrame:
    """Share of rows on which each pair of prediction columns agrees, in one pass."""
    names = list(models)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    one = df.agg(*[F.avg((F.col(models[a]) == F.col(models[b])).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"c{i}").alias("agreement")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(cells))
