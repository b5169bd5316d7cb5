"""Delimited files, SQL files and dimension lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header row and a given schema.

    ``encoding="windows-1251"`` needs ``spark.sql.legacy.javaCharsets`` (set by ``session.tune``).
    """
    paths = path if isinstance(path, str) else list(path)
    return spark.read.schema(schema).csv(paths, sep=sep, header=True, encoding=encoding)


def read_price_files(spark: SparkSession, path: str | Sequence[str], schema: str, lots: DataFrame, name_pattern: str = r"([^/_]+)_[^/]*$") -> DataFrame:
    """One price file per paper, all in one scan: the paper comes from the file name, and the
    close price is multiplied by the lot size. Files of papers without a lot size are dropped."""
    rows = read_delimited(spark, path, schema).withColumn("paper", F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 1))
    return (
        rows.join(lots, F.col("paper") == F.col("stock"))
        .select("date", "paper", (F.col("close") * F.col("stock_in_lot")).alias("close"))
    )


def run_sql_file(spark: SparkSession, path: str, views: Mapping[str, DataFrame] | None = None, args: Mapping[str, object] | None = None) -> DataFrame:
    """Run the query in a file over named frames; ``:name`` markers are bound from ``args``.

    The names are views only while the query is analysed; views that the session had come back.
    """
    text = Path(path).read_text(encoding="utf-8").strip().rstrip(";")
    views = views or {}
    before = {name: spark.table(name) for name in views if spark.catalog.tableExists(name)}
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=dict(args)) if args else spark.sql(text)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)


def named_dataset(df: DataFrame, features: Sequence[str], target: str, names: Mapping[int, str] | None = None) -> DataFrame:
    """A labelled data set: feature columns renamed, class numbers replaced by names."""
    out = df.toDF(*features, target)
    if names:
        mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        out = out.withColumn(target, F.try_element_at(mapping, F.col(target)))
    return out
