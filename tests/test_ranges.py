"""Ranges of whole order tuples: even where many rows agree in the first columns."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.operators import windows


def same(a, b, columns):
    got, want = a.select(*columns).collect(), b.select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_third_of_the_rows_at_one_key_and_time(spark, monkeypatch):
    """Ranges are cut between rows that agree in the first order columns; sums and lags stay right."""
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", 500)
    df = spark.range(12_000).selectExpr(
        "if(id % 3 = 0, 7, id % 11) AS k", "if(id % 3 = 0, 5.5D, if(id % 100 = 1, NULL, double(id % 400) / 8)) AS at",
        "if(id % 6 = 0, 'same', string(id % 50)) AS kind", "id", "id % 9 AS v").repartition(6)
    order = ["at", "kind", "id"]
    ranged, many = windows._ranged(df, order)
    sizes = {r[windows._RANGE]: r["count"] for r in ranged.groupBy(windows._RANGE).count().collect()}
    assert many and max(sizes.values()) <= 500 and len(sizes) > 30
    # Ranges follow the order.
    ends = ranged.groupBy(windows._RANGE).agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi")).orderBy(windows._RANGE).collect()
    assert [r.lo.id for r in ends] == [r.lo.id for r in sorted(ends, key=lambda r: (r.lo["at"] is not None, r.lo["at"] or 0, r.lo.kind, r.lo.id))]
    w = Window.partitionBy("k").orderBy(*order)
    got = windows.running_sums(df, {"t": (["k"], F.col("v"))}, order)
    same(got, df.withColumn("t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))), ["id", "t"])
    same(windows.previous_value(df, ["k"], order, "v", "p"), df.withColumn("p", F.lag("v").over(w)), ["id", "p"])
    # Rows that share a total are one row before the window, however many there are.
    got = windows.running_sums(df, {"t": (["k"], F.col("v"))}, ["at"], "range")
    same(got, df.withColumn("t", F.sum("v").over(Window.partitionBy("k").orderBy("at"))), ["id", "t"])


def test_a_small_table_needs_no_bounds(spark, monkeypatch):
    from tidebook.operators import ranges

    monkeypatch.setattr(ranges, "_bounds", lambda *_: pytest.fail("sampled"))
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", 100)
    assert windows.row_index(spark.range(100), "id", "n").where("n = id").count() == 100


def test_bounds_of_every_type(spark, monkeypatch):
    from tidebook.operators.ranges import ranges_of

    df = spark.range(2000).selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7 % 2000 + 0.123456) AS at", "date_add(date'2024-01-01', int(id % 700)) AS day",
        "CAST(id * 7 % 1999 AS decimal(12,4)) / 3 AS price", "double(id) / 7 - 3 AS ratio", "string(id) AS name", "id % 2 = 0 AS flag", "id")
    for column in ("at", "day", "price", "ratio", "name"):
        number, count = ranges_of(df, ["flag", column], 100)
        rows = df.withColumn("r", number).groupBy("r").agg(F.count("*").alias("n"), F.min(F.struct("flag", column)).alias("lo"), F.max(F.struct("flag", column)).alias("hi")).orderBy("r").collect()
        assert count >= len(rows) > 15 and max(r.n for r in rows) <= 100, column
        assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(rows, rows[1:])), column
