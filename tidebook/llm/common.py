"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.session import materialize, shared_dir

__all__ = ["crc_fold", "materialize", "ranked", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Workers import this package from where the driver has it, unless it is installed.
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a NULL id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, buckets: int = 1024, weight: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Position 0.. (or running weight before the row) per key, in the order (bucket, ``order``).

    The bucket is a hash of ``order`` unless given, so a key that holds much of the table is spread over
    ``buckets`` tasks; only one row per (key, bucket) goes through the per-key window. Rows
    that agree in every order column are interchangeable.
    """
    spread = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket
    body = df.withColumn("__b", spread).withColumn("__w", F.lit(1) if weight is None else weight)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = body.groupBy(*keys, "__b").agg(F.sum("__w").alias("__t")).withColumn("__s", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        body.join(starts, [*keys, "__b"])
        .withColumn(out, (F.col("__s") + F.sum("__w").over(inside) - F.col("__w")).cast("long"))
        .drop("__b", "__w", "__s")
    )
