"""Writing results."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

COMMITS = "load string, attempt string, at long"


def write_attempt(df: DataFrame, path: str, load: str, by: Sequence[str] = ()) -> str:
    """Write one attempt at a load and return its name. Nobody reads it before ``commit_load``."""
    attempt = uuid.uuid4().hex
    df.write.mode("errorifexists").partitionBy(*by).parquet(f"{path}/data/load={load}/attempt={attempt}")
    return attempt


def commit_load(spark: SparkSession, path: str, load: str, attempt: str) -> None:
    """Make an attempt the content of its load; the latest commit counts."""
    row = spark.createDataFrame([(load, attempt, time.time_ns())], COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append_load(df: DataFrame, path: str, load: str, by: Sequence[str] = ()) -> None:
    """Append a load under its id. A load that is sent again replaces itself; one that broke off is not seen.

    Each attempt has a folder of its own and counts once its commit is written, so readers never
    see half a load and a retry needs no clean-up. ``by`` are partition columns, which keep later
    reads to the parts they need. The id must be usable as a folder name.
    """
    if not re.fullmatch(r"[\w.-]+", load):
        raise ValueError(f"a load id has letters, digits, _, . and - only: {load!r}")
    commit_load(df.sparkSession, path, load, write_attempt(df, path, load, by))


def read_loads(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The committed rows of all loads, with the ``load`` they came with; ``schema`` includes the partition columns.

    The commits are joined to the partitions, not collected, so their number is not limited.
    """
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType([*kinds.fields, StructField("load", StringType()), StructField("attempt", StringType())])
    commits = spark.read.schema(COMMITS).parquet(f"{path}/commits").groupBy("load").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))
    return spark.read.schema(full).parquet(f"{path}/data").join(commits, ["load", "attempt"], "left_semi").drop("attempt")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def replace_table(df: DataFrame, name: str, path: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Create or replace a table from a query and return it. Give ``path`` to keep the files in a shared folder."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if by:
        writer = writer.partitionBy(*by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
