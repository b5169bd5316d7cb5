"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import math
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that can change at run time; applied by every registered query so a
# session built elsewhere gets the same plans.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on a hot user is often followed by a group-by on the same user. Without
    # this AQE would refuse to split the hot partition, as that adds one exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Text columns read as windows-1251 (see sources.files.read_delimited).
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(app: str = "tidebook", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


_local_root: str | None = None


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder all executors see (``spark.checkpoint.dir``), removed when the session's JVM ends.

    Without the setting only a plain local master is served, whose driver and executor are one
    process: by a temporary folder of that process. Every other master must set it.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if not _local_root:
            _local_root = tempfile.mkdtemp(prefix="tidebook-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        root = f"file://{_local_root}"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, unless it is installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def materialize(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder (with the writer's ``options``) and read it back.

    Used where a costly result feeds several passes: unlike a cache it survives the loss
    of executors, and it cuts the lineage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.options(**options).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows that one task can train on or score at ease.
ROWS_PER_FILE = 50_000


def spread(df: DataFrame, label: str = "spread", rows: int = ROWS_PER_FILE) -> DataFrame:
    """``df`` stored in files of about ``rows`` rows each, if it has more than that.

    A small file with many rows is read by one task, and a model that passes over it stays in
    that task; its files are read by as many tasks as there are cores.
    """
    n = df.count()
    return df if n <= rows else materialize(df.repartition(math.ceil(n / rows)), label)
