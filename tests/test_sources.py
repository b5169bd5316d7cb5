import pytest
from pyspark.sql import functions as F

from tidebook import session
from tidebook.functions import scalars
from tidebook.sources import files, sinks


def test_cp1251_file(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_bytes("DATE_BEGIN;AMOUNT;KIND\n01.02.2016;1500,75;УСН\n31.12.2016;10;ЕНВД\n".encode("cp1251"))
    session.tune(spark)
    df = files.read_delimited(spark, str(path), "day string, amount string, kind string", sep=";", encoding="windows-1251")
    got = df.select(F.to_date("day", "dd.MM.yyyy").alias("d"), scalars.decimal_comma(F.col("amount")).alias("a"), "kind").collect()
    assert [(str(r.d), r.a, r.kind) for r in got] == [("2016-02-01", 1500.75, "УСН"), ("2016-12-31", 10.0, "ЕНВД")]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2016-02-30",), ("x",), ("2016-02-29",)], "d string")
    assert [str(r[0]) for r in df.select(F.try_to_date("d", "yyyy-MM-dd")).collect()] == ["None", "None", "2016-02-29"]


def test_price_files(spark, tmp_path):
    for paper, close in (("SBER", 10.5), ("GAZP", 3.0), ("OTHER", 1.0)):
        (tmp_path / f"{paper}_070601_180903.csv").write_text(f"<DATE>,<TIME>,<CLOSE>\n2018-01-09,0,{close}\n")
    lots = spark.createDataFrame([("SBER", 10), ("GAZP", 100)], "stock string, stock_in_lot int")
    got = files.read_price_files(spark, str(tmp_path), "date date, time string, close double", lots)
    assert sorted((r.paper, r.close) for r in got.collect()) == [("GAZP", 300.0), ("SBER", 105.0)]


def test_sql_file_with_parameter(spark, tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("-- 100%% of rows\nSELECT id FROM numbers WHERE id < :top;\n")
    got = files.run_sql_file(spark, str(path), {"numbers": spark.range(10)}, {"top": 3})
    assert [r.id for r in got.collect()] == [0, 1, 2]


def test_loads_are_repeatable(spark, tmp_path):
    path, schema = str(tmp_path / "q"), "id bigint, dt date"
    rows = spark.range(10).withColumn("dt", F.lit("2024-01-01").cast("date"))
    sinks.append_load(rows, path, "a", ["dt"])
    sinks.append_load(rows.withColumn("dt", F.lit("2024-01-02").cast("date")), path, "b", ["dt"])
    back = sinks.read_loads(spark, path, schema)
    late = back.where("dt = DATE '2024-01-02'")
    assert late.count() == 10 and "PartitionFilters: [isnotnull(dt" in late._jdf.queryExecution().executedPlan().toString()
    # Sent again, with other rows and another day: it replaces itself, days that it no longer has are gone.
    sinks.append_load(rows.limit(3).withColumn("dt", F.lit("2024-01-03").cast("date")), path, "b", ["dt"])
    attempt = sinks.write_attempt(rows, path, "c", ["dt"])  # breaks off before its commit

    def counts():
        return sorted((r["load"], str(r.dt), r["count"]) for r in sinks.read_loads(spark, path, schema).groupBy("load", "dt").count().collect())

    assert counts() == [("a", "2024-01-01", 10), ("b", "2024-01-03", 3)]
    sinks.commit_load(spark, path, "c", attempt)
    assert counts()[-1] == ("c", "2024-01-01", 10)
    sinks.append_load(rows.limit(0), path, "a", ["dt"])  # an empty load replaces too
    assert [c[0] for c in counts()] == ["b", "c"]
    with pytest.raises(ValueError):
        sinks.append_load(rows, path, "x/y")


def test_many_loads_are_joined_not_collected(spark, tmp_path):
    path = str(tmp_path / "q")
    for i in range(4):
        sinks.append_load(spark.range(i + 1), path, f"2024-01-{i:02d}")
    got = sinks.read_loads(spark, path, "id bigint")
    assert got.count() == 10 and "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()


def test_named_dataset(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 9)], "x double, y int")
    got = files.named_dataset(df, ["petal"], "target", {0: "setosa"}).collect()
    assert [(r.petal, r.target) for r in got] == [(1.0, "setosa"), (2.0, None)]


def test_shared_dir_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = type("S", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        session.shared_dir(Fake(), "x")


def test_shared_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = session.shared_dir(spark, "x"), session.shared_dir(spark, "x")
    assert first != second and first.startswith(root or "/")


def test_materialize_cuts_the_lineage(spark):
    out = session.materialize(spark.range(5).withColumn("x", F.col("id") * 2), "five")
    assert out.count() == 5 and out.columns == ["id", "x"]
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()
