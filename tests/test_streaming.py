"""Streams fed in several steps give what the batch job gives."""

import datetime as dt

from pyspark.sql import functions as F

from tidebook.plans import rejects
from tidebook.streaming import jobs

SCHEMA = "event_id long, uuid string, login long, response_result int, request_ts timestamp_ntz, comment string"


def event(i, minute, login=1, result=2):
    return (i, "u", login, result, dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute), "c")


def run(spark, parts, job, tmp_path, schema):
    """Feed one file at a time to one checkpointed query."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    found = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        found = job(spark.readStream.schema(schema).parquet(source))
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def test_reject_minutes_over_batches(spark, tmp_path):
    first = [event(0, 0), event(1, 0), event(2, 0, login=2), event(3, 1, result=1)]
    second = [event(4, 1), event(5, 1), event(6, 2, login=2), event(7, 2, login=2)]
    last = [event(99, 600, login=9, result=1)]  # only moves the watermark
    got = run(spark, [first, second, last], lambda s: jobs.reject_minutes(s), tmp_path, SCHEMA)
    batch = rejects.busy_logins(spark.createDataFrame(first + second, SCHEMA), F.date_trunc("minute", "request_ts"))
    pick = ["scoring_time", "login", "cnt_reset_req", "cnt_req"]
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, batch.select(*pick).collect()))
    assert got.count() == 3


def test_late_rows_within_the_allowance_count(spark, tmp_path):
    parts = [[event(0, 0)], [event(1, 8)], [event(2, 0)], [event(3, 300, login=9, result=1)]]
    got = run(spark, parts, lambda s: jobs.reject_minutes(s), tmp_path, SCHEMA)
    assert [(r.login, r.cnt_req) for r in got.collect()] == [(1, 2)]


def test_latest_version_over_batches(spark, tmp_path):
    schema = "uid long, seq long, updated timestamp_ntz, muslim int"
    day = dt.datetime(2024, 1, 1)
    parts = [[(1, 1, day, 1)], [(1, 2, day + dt.timedelta(hours=5), None), (2, 3, day, 0)], [(1, 4, day + dt.timedelta(hours=3), 0)], [(9, 9, day + dt.timedelta(days=9), 1)]]
    got = run(spark, parts, lambda s: jobs.latest_per_day(s, "uid", "updated", "seq", ["muslim"]), tmp_path, schema)
    assert sorted((r.uid, str(r.updated_day), r.muslim) for r in got.collect()) == [(1, "2024-01-01", 0), (2, "2024-01-01", 0)]


VERSIONS = "uid long, seq long, updated timestamp_ntz, muslim int"


def upserts(spark, tmp_path, part=None):
    """Feed one more file to the update-mode query and read the table."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    if part is not None:
        spark.createDataFrame(part, VERSIONS).coalesce(1).write.mode("append").parquet(source)
    found = jobs.latest_per_day(spark.readStream.schema(VERSIONS).parquet(source), "uid", "updated", "seq", ["muslim"])
    return jobs.run_to_upserts(found, "x", ["uid", "updated_day"], out, state), found.schema


def rows_of(frame):
    return sorted((r.uid, str(r.updated_day), r.muslim) for r in frame.collect())


def test_update_mode_has_every_day_at_once(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    got, _ = upserts(spark, tmp_path, [(1, 1, day, 1), (3, 1, day, 1)])
    assert rows_of(got) == [(1, "2024-01-01", 1), (3, "2024-01-01", 1)]
    upserts(spark, tmp_path, [(1, 2, day + dt.timedelta(hours=5), None), (2, 3, day, 0), (1, 9, day + dt.timedelta(days=1), 5)])
    got, schema = upserts(spark, tmp_path, [(1, 4, day + dt.timedelta(hours=3), 0)])  # late, but newer than the first version
    want = [(1, "2024-01-01", 0), (1, "2024-01-02", 5), (2, "2024-01-01", 0), (3, "2024-01-01", 1)]
    assert rows_of(got) == want
    again, _ = upserts(spark, tmp_path)  # nothing new
    assert rows_of(again) == want
    # Every batch once more, as after a crash before its commit, and batch 1 a third time.
    out, keys = str(tmp_path / "out"), ["uid", "updated_day"]
    sent = [spark.read.parquet(out).where(F.col("batch") == number).drop("batch").collect() for number in range(3)]
    for number in [0, 1, 2, 1]:
        jobs.upsert_batch(spark.createDataFrame(sent[number], schema), number, out)
    assert rows_of(jobs.upserted(spark, out, schema, keys)) == want
    packed = jobs.compact(spark, out, schema, keys, str(tmp_path / "packed"))
    assert rows_of(packed) == want and spark.read.parquet(str(tmp_path / "packed")).count() == 4


def test_update_mode_without_rows(spark, tmp_path):
    got, _ = upserts(spark, tmp_path, [])
    assert got.count() == 0 and got.columns == ["uid", "updated_day", "muslim"]
