"""Recurring jobs on streams. Each takes a streaming DataFrame and reuses the batch expressions."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidebook.operators.aggregates import newest
from tidebook.plans.rejects import busy_logins
from tidebook.session import shared_dir
from tidebook.sources.quotes import session_load

# State lives on the executors' disks and in the checkpoint, not in their heaps.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def quotes(stream: DataFrame, at: str, price: str, **session) -> DataFrame:
    """Stateless: the session filter and the load stamp of the batch job."""
    return session_load(stream, at, price, **session)


def reject_minutes(responses: DataFrame, at: str = "request_ts", size: str = "1 minute", late: str = "10 minutes", more_than: int = 1) -> DataFrame:
    """Per window and account: rejects and requests, once the window can no longer change."""
    stamped = responses.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    found = busy_logins(stamped, F.window(at, size), more_than)
    return found.select(F.col("scoring_time.start").alias("scoring_time"), "login", "cnt_reset_req", "cnt_req")


def latest_per_day(profiles: DataFrame, key: str, updated: str, tie: str, values: list[str], late: str = "1 day") -> DataFrame:
    """The newest values per key and day: in update mode whenever they change, in append mode when the day is complete."""
    stamped = profiles.withColumn(updated, F.col(updated).cast("timestamp")).withWatermark(updated, late)
    return stamped.groupBy(F.window(updated, "1 day").alias("w"), key).agg(*[newest(v, updated, tie).alias(v) for v in values]).select(
        key, F.to_date("w.start").alias("updated_day"), *values)


def upsert_batch(batch: DataFrame, number: int, path: str) -> None:
    """Keep one micro-batch of changed rows under its number; the same batch sent again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def upserted(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row per key over all batches. An aggregate, so hot keys are reduced before the shuffle."""
    full = StructType([*schema.fields, StructField("batch", LongType())])
    rest = [f.name for f in schema.fields if f.name not in keys]
    newest_rows = spark.read.schema(full).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return newest_rows.select(*[c if c in keys else F.col(f"__r.{c}").alias(c) for c in schema.names])


def compact(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], target: str) -> DataFrame:
    """Write the newest rows as the single batch -1 of a new folder; later batches may be added there."""
    upsert_batch(upserted(spark, path, schema, keys), -1, target)
    return upserted(spark, target, schema, keys)


def run_to_upserts(stream: DataFrame, label: str, keys: Sequence[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is there in update mode, upsert the changed rows by ``keys``, and return the table.

    A row is out as soon as it is known and again whenever it changes. A batch that runs again
    after a crash has its old number and replaces itself, so nothing is doubled. Given the same ``path``
    and ``checkpoint`` a later run goes on from there.
    """
    spark = stream.sparkSession
    path, checkpoint = path or shared_dir(spark, label), checkpoint or shared_dir(spark, f"{label}-checkpoint")
    upsert_batch(spark.createDataFrame([], stream.schema), -2, path)  # a source without rows gives an empty table
    with _state_store(spark):
        running = (
            stream.writeStream.outputMode("update").foreachBatch(lambda batch, number: upsert_batch(batch, number, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    running.awaitTermination()
    return upserted(spark, path, stream.schema, keys)


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The settings hold while a query starts, which keeps them."""
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_files(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there, append it to files in the shared folder, and return the files as a frame."""
    spark = stream.sparkSession
    path, checkpoint = shared_dir(spark, label), shared_dir(spark, f"{label}-checkpoint")
    with _state_store(spark):
        running = (
            stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
