"""Work that must not gather in one task or be repeated for every row."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidebook import session
from tidebook.llm import lines
from tidebook.models import text, trees
from tidebook.operators import windows
from tidebook.plans import risk


def test_node_features_are_drawn_once_per_node(spark, monkeypatch):
    rows = spark.range(300).select("id", *[(F.col("id") % (i + 2)).cast("double").alias(f"f{i}") for i in range(4)], (F.col("id") % 3 == 0).cast("int").alias("y"))
    plans = []
    real = trees._best_cuts

    def seen(*args):
        out = real(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(trees, "_best_cuts", seen)
    forest = trees.grow(rows, [f"f{i}" for i in range(4)], "y", "id", trees=3, depth=3, min_leaf=1, sampled=True, per_node=2, seed=4)
    assert plans and all("md5" not in p for p in plans)  # neither a row's draws nor a node's features are hashed again by a level
    picked = [(t, n, f) for t, n, f, *_ in forest.nodes if f is not None]
    assert picked
    for t, n, f in picked:
        order = sorted(range(4), key=lambda i: hashlib.md5(f"4|{t}|{n}|{i}".encode()).hexdigest())
        assert f in [f"f{i}" for i in order[:2]]


def test_spread_deals_a_long_file_to_many_tasks(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(5000).withColumn("v", F.when(F.col("id") % 7 > 0, F.col("id") % 5)).repartition(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert rows.rdd.getNumPartitions() == 1
    dealt = session.spread(rows, rows=500)
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(rows.collect())
    assert session.spread(rows, rows=5000) is rows


@pytest.mark.parametrize("name", ["_churn", "_companies"])
def test_company_rows_are_spread(spark, tables, monkeypatch, name):
    from tidebook.catalog import models

    labels = []
    monkeypatch.setattr(models, "spread", lambda df, label: labels.append(label) or df)
    getattr(models, name)(tables)
    assert labels == [name[1:]]


def test_margins_shuffle_texts_once(spark):
    docs = spark.createDataFrame([(i, f"some words w{i % 5} and v{i % 3} here", "ab"[i % 2]) for i in range(60)], "id int, t string, c string")
    model = text.fit_text_classifier(docs, "t", "c", "id", rounds=2)
    plan = model.margins(docs, "id")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_more_terms_than_are_sent_give_the_same_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words w{i % 5} and v{i % 3} here", "ab"[i % 2]) for i in range(60)], "id int, t string, c string")
    found = []
    for most in (text.MOST_SENT, 0):
        monkeypatch.setattr(text, "MOST_SENT", most)
        model = text.fit_text_classifier(docs, "t", "c", "id", rounds=3)
        found.append({(r.term, r["class"]): round(r.weight, 12) for r in model.table().collect()} | {r.id: r.predicted for r in model(docs, "id").collect()})
    assert found[0] == found[1] and len(found[0]) > 60


def test_only_rows_of_large_keys_are_cut(spark, monkeypatch):
    """A key of 5,000 rows is cut into ranges; the opening rows of 5,000 small keys are not made."""
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", 500)
    df = spark.range(10_000).selectExpr("if(id % 2 = 0, 7, nullif(id, 9)) AS k", "id % 3 AS side", "id * 7 % 10007 AS at", "id", "if(id % 5 > 0, id % 11, NULL) AS v")
    ranged, many = windows._ranged(df, ["at"], ["k"])
    sizes = {(r.k, r[windows._RANGE]): r["count"] for r in ranged.groupBy("k", windows._RANGE).count().collect()}
    small = {r for k, r in sizes if k != 7}
    assert many and len(sizes) > 5010 and max(sizes.values()) <= 500 and -1 in small
    assert sum(r >= 0 for k, r in sizes if k != 7) < 20
    got = windows.running_sums(df, {"t": (["k"], F.col("v")), "ts": (["k", "side"], F.coalesce("v", F.lit(1)))}, ["at"])
    assert "__v" not in "".join(got.columns)
    want = df.selectExpr("id", "SUM(v) OVER (PARTITION BY k ORDER BY at ROWS UNBOUNDED PRECEDING) AS t", "SUM(coalesce(v, 1)) OVER (PARTITION BY k, side ORDER BY at ROWS UNBOUNDED PRECEDING) AS ts")
    assert sorted(map(repr, got.select("id", "t", "ts").collect())) == sorted(map(repr, want.collect()))


def test_small_keys_are_shuffled_once(spark, tables, monkeypatch):
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", 5_000)
    out = risk.exposure_timeline(tables.fx_orders_mt4, tables.fx_deals_mt5, tables.fx_segments, "1995-01-01", "1997-01-01", None)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert out.count() > 5_000 and plan.count("Exchange hashpartitioning") == 1
    assert out.columns == ["user_uid", "date_deal", "symbol", "first_deal_way", "volume_usd", "profit", "cumsum", "cumsum_way", "segment"]


def test_words_are_cut_without_compiling_a_pattern_per_line(spark):
    """A split at a pattern of more than one character compiles it for every line."""
    text = ["a b c d e", "  a  b", "\ta\tb c 1", "x ", "", "  ", "\r", "a b\r", "a b c  ", "one@x two\x0b\x0c3 four ", "ä   é ", "x\n\ny z"]
    df = spark.createDataFrame(list(enumerate(text)), "id int, line string")
    leaves = lines._with_leaf(df)
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert "regexp_count" not in plan and "split(" in plan and "]+, 4)" not in plan
    assert {r.id for r in leaves.collect()} == {i for i, t in enumerate(text) if t.strip(" \t\n\x0b\x0c\r")}
    got = {r.id: r.w for r in leaves.select("id", lines._words(F.col("line")).alias("w")).collect()}
    assert got == {i: re.findall(r"[^ \x09-\x0D]+", text[i]) for i in got}
