"""Streaming jobs, run to the end of the stored events and read back from their sink."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.catalog.registry import query
from tidebook.streaming import jobs
from tidebook.tables import BASE_SCHEMAS, PROJECTIONS, Tables


def stream(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(BASE_SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(t.root)


def projected(t: Tables, projection: str, base: str) -> DataFrame:
    """A one-table projection over the stream of its table."""
    return t.spark.sql(PROJECTIONS[projection], **{base: stream(t, base)})


@query("stream_quotes_append", """
SELECT event_id, value AS price, ts AS dt_load FROM events
WHERE hour(ts) BETWEEN 12 AND 21 AND dayofweek(ts) BETWEEN 0 AND 4 AND value IS NOT NULL AND value != 0""")
def _(t):
    rows = stream(t, "events").select("event_id", F.col("value").alias("price"), "ts")
    return jobs.run_to_files(jobs.quotes(rows, "ts", "price"), "stream-quotes")


# A window is out when its end is not after the newest event time less the allowed lateness;
# Spark filters before it reads the event time, so only counted responses move the watermark.
@query("stream_reject_minutes", """
WITH kept AS (SELECT * FROM fx_responses WHERE response_result IN (1, 2, 3) AND uuid != ''), top AS (SELECT MAX(request_ts) AS top FROM kept)
SELECT date_trunc('hour', request_ts) AS scoring_time, login, COUNT(*) FILTER (response_result = 2) AS cnt_reset_req, COUNT(*) AS cnt_req
FROM kept CROSS JOIN top WHERE date_trunc('hour', request_ts) + INTERVAL 1 HOUR <= top - INTERVAL 10 MINUTE
GROUP BY 1, 2 HAVING COUNT(*) FILTER (response_result = 2) > 1""")
def _(t):
    found = jobs.reject_minutes(projected(t, "fx_responses", "events"), size="1 hour")
    return jobs.run_to_files(found, "stream-rejects").withColumn("scoring_time", F.col("scoring_time").cast("timestamp_ntz"))


@query("stream_latest_version", """
SELECT uid, CAST(updated AS DATE) AS updated_day, arg_max(muslim, (updated, seq)) AS muslim, arg_max(status, (updated, seq)) AS status
FROM fx_swap_profiles GROUP BY 1, 2""")
def _(t):
    found = jobs.latest_per_day(projected(t, "fx_swap_profiles", "orders"), "uid", "updated", "seq", ["muslim", "status"])
    return jobs.run_to_upserts(found, "stream-profiles", ["uid", "updated_day"])


@query("stream_complete_days", """
WITH top AS (SELECT MAX(updated) AS top FROM fx_swap_profiles)
SELECT uid, CAST(updated AS DATE) AS updated_day, arg_max(muslim, (updated, seq)) AS muslim, arg_max(status, (updated, seq)) AS status
FROM fx_swap_profiles CROSS JOIN top WHERE date_trunc('day', updated) + INTERVAL 1 DAY <= top - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(t):
    found = jobs.latest_per_day(projected(t, "fx_swap_profiles", "orders"), "uid", "updated", "seq", ["muslim", "status"])
    return jobs.run_to_files(found, "stream-days")
