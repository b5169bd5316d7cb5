"""The plans: pruning, push-down, no Python, no cross join, hot keys split."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA
from tidebook.plans import users

QUERIES = entry.queries()
REPORTS = [
    "hedge_stopout", "exposure_timeline", "mirror_locker_features", "rounders", "swap_free_cost", "country_stats", "top_trader_profile", "user_funnel",
    "spread_by_instrument", "reject_leaders", "user_trades", "top_rejected_profit", "reject_streaks", "reject_share", "reject_minutes", "toxicity_counts",
    "loan_issuance", "churn_features", "churn_breakdown", "monthly_plan", "class_stats", "store_cleaning", "link_extract", "article_extract", "post_cleaning", "tfidf",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", REPORTS)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    for bad in ("PythonUDF", "EvalPython", "InPandas", "BatchEval", "CartesianProduct"):
        assert bad not in text
    # Constant legs and sides are expanded in place; nothing is joined without a key.
    assert "BroadcastNestedLoopJoin" not in text


def test_time_windows_reach_the_scan(spark, tables):
    from tidebook.plans import risk

    text = plan(risk.spread_rows(tables.fx_deals_mt5, tables.fx_orders_mt4, "1996-01-01", "1997-01-01", None))
    assert "GreaterThanOrEqual(l_shipdate" in text and "GreaterThanOrEqual(o_orderdate" in text


def test_columns_are_pruned(spark, tables):
    text = plan(users.country_stats(tables.fx_users, tables.fx_balance))
    assert "c_name" not in text and "o_orderpriority" not in text


def test_maximum_filter_needs_no_window(spark, tables):
    """However many rows tie for the maximum, none of them meets another in one task."""
    from tidebook.operators.aggregates import top_with_ties

    text = plan(users.top_trader_profile(tables.fx_trades, tables.fx_users))
    assert "Window" not in text
    tied = spark.createDataFrame([(i, 5.0 if i % 2 else None) for i in range(100)] + [(200, 1.0)], "id long, s double")
    assert {r.id for r in top_with_ties(tied, "s").collect()} == set(range(1, 100, 2))


def test_distinct_counts_do_not_gather_a_group(spark):
    text = plan(QUERIES["cond_count_distinct"](spark, DATA))
    assert "collect_set" not in text and "Expand" in text


def test_hot_join_key_is_split(spark):
    """A user with a third of the trades is split by AQE although a group-by on the user follows."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 200_000
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).cast("bigint")
        at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz")
        trades = spark.range(0, n, 1, 16).select(
            hot.alias("user_id"), at.alias("open_time"), at.alias("close_time"), F.col("id").alias("order_id"), F.lit(1).alias("line_no"),
            (F.col("id") % 10).cast("decimal(18,2)").alias("profit_usd")).repartition(16)
        people = spark.range(1000).select(F.col("id").alias("user_id"), F.lit("A").alias("country_code"), F.lit("2023-11-01").cast("date").alias("registration_time"))
        balance = trades.select("user_id", F.lit("deposit").alias("operation_type"), F.col("open_time").alias("operation_time"), F.col("profit_usd").alias("operation_amount_usd"))
        funnel = users.user_funnel(people, trades, balance)
        total = funnel.agg(F.sum("total_profit"), F.sum("profit_30_days")).first()
        assert total[0] == total[1] == sum(i % 10 for i in range(n))
        funnel.collect()
        assert "SortMergeJoin(skew=true)" in plan(funnel)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_registration_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rsplit("/", 1)[0], timeout=120)
    assert out.returncode == 0, out.stderr
