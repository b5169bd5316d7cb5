"""Windows over ranges against plain ones, on data where one key holds a third of the rows."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.operators import windows

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(params=[40, 700, 10**9], autouse=True)
def ranges(request, monkeypatch):
    """Each case with many ranges, a few, and one."""
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", request.param)
    return request.param


@pytest.fixture(scope="module")
def rows(spark):
    """Hot key 7, a NULL key, ties in time, NULL values."""
    data = []
    for i in range(3000):
        key = 7 if i % 3 == 0 else (None if i % 50 == 1 else i % 17)
        at = START + datetime.timedelta(minutes=(i * 37) % 2000)
        word = "a" if (i * 7) % 5 < 3 else ("b" if i % 11 else None)
        data.append((key, "xy"[i % 2], at, i, float(i % 13 - 6) if i % 29 else None, word))
    return spark.createDataFrame(data, "k int, side string, at timestamp_ntz, id int, v double, word string").repartition(5).cache()


def same(a, b, columns):
    pick = [F.col(c) for c in columns]
    got, want = a.select(*pick).collect(), b.select(*pick).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_running_sums_rows(rows):
    got = windows.running_sums(
        rows, {"t": (["k"], F.col("v")), "ts": (["k", "side"], F.col("v"))}, ["at", "id"])
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    ws = Window.partitionBy("k", "side").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"t": F.sum("v").over(w), "ts": F.sum("v").over(ws)})
    same(got, want, ["k", "id", "t", "ts"])


def test_running_sum_range_shares_peers(rows):
    got = windows.running_sums(rows, {"t": (["k"], F.col("v"))}, ["at"], "range")
    want = rows.withColumn("t", F.sum("v").over(Window.partitionBy("k").orderBy("at")))
    same(got, want, ["k", "id", "t"])


def test_last_running_sum_is_the_total(rows):
    got = windows.running_sums(rows, {"t": (["k"], F.coalesce("v", F.lit(0.0)))}, ["at", "id"])
    last = got.groupBy("k").agg(F.max_by("t", F.struct("at", "id")).alias("t"))
    same(last, rows.groupBy("k").agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("t")), ["k", "t"])


def test_previous_value(rows):
    got = windows.previous_value(rows, ["k"], ["at", "id"], "word", "prev")
    want = rows.withColumn("prev", F.lag("word").over(Window.partitionBy("k").orderBy("at", "id")))
    same(got, want, ["k", "id", "word", "prev"])


def test_streaks(rows):
    got = windows.repeated_value_streaks(rows, ["k"], ["at", "id"], "word", "a")
    w = Window.partitionBy("k").orderBy("at", "id")
    hit = F.coalesce((F.col("word") == "a") & (F.lag("word").over(w) == "a"), F.lit(False)).cast("bigint")
    want = rows.withColumn("h", hit).groupBy("k").agg(F.sum("h").alias("max_incidents"))
    same(got, want, ["k", "max_incidents"])


def test_event_counter_steps_on_condition(spark):
    data = [(1, i, c) for i, c in enumerate(["x", "R", "x", None, "R", "x"])]
    df = spark.createDataFrame(data, "login int, at int, c string")
    got = windows.conditional_event_counter(df, ["login"], ["at"], F.col("c") == "R", "g")
    assert [r.g for r in got.orderBy("at").collect()] == [0, 1, 1, 1, 2, 2]


def test_row_index_is_dense_and_ordered(spark):
    ids = [i * i for i in range(500)] + [-5, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "key bigint").repartition(7)
    got = {r.key: r.id for r in windows.row_index(df, "key").collect()}
    assert got.pop(None) == len(ids) and [got[i] for i in sorted(ids)] == list(range(len(ids)))


def test_first_row_keeps_a_null_payload(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (2, 5, "c")], "u int, at int, c string")
    got = windows.first_row(df, ["u"], ["at"], ["c", "at"]).orderBy("u").collect()
    assert [(r.u, r.c, r["at"]) for r in got] == [(1, None, 1), (2, "c", 5)]


def test_no_task_holds_a_hot_key(spark, monkeypatch):
    """Half of all rows have one key; no (key, range) has more than a small share of them."""
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", 500)
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 7, id) AS k", "id * id AS at", "id")
    ranged, many = windows._ranged(df, ["at"])
    sizes = [r["count"] for r in ranged.groupBy("k", windows._RANGE).count().collect()]
    assert many and max(sizes) <= 600
    got = windows.running_sums(df, {"t": (["k"], F.col("id"))}, ["at"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    body = [line for line in plan.splitlines() if "Window [" in line and "__body" in line]
    assert body and all("__range" in line for line in body)
