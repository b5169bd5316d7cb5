"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import as_double, as_long, dbl, query
from tidebook.catalog.reports import IRIS, IRIS_SQL, PLAN_CTES, _ledger, iris
from tidebook.functions import scalars
from tidebook.operators import aggregates, joins, sketches
from tidebook.operators.aggregates import newest
from tidebook.operators.percentiles import approx_percentiles, exact_percentiles
from tidebook.plans import loans, portfolio, risk, users
from tidebook.session import materialize

def n_rows():
    return F.count(F.lit(1))


@query("group_sum", "SELECT user_id, CAST(SUM(profit_usd) AS DOUBLE) AS total_profit FROM fx_trades GROUP BY user_id")
def _(t):
    return t.fx_trades.groupBy("user_id").agg(F.sum("profit_usd").cast("double").alias("total_profit"))


@query("multi_agg", """
SELECT user_uid, CAST(SUM(volume_closed_usd) AS DOUBLE) AS vol, CAST(SUM(volume) AS BIGINT) AS lot, MAX(volume) AS max_lot,
  COUNT(volume_closed_usd) AS n, COUNT(CASE WHEN volume <= 100 THEN 1 END) AS small FROM fx_orders_mt4 GROUP BY user_uid""")
def _(t):
    return t.fx_orders_mt4.groupBy("user_uid").agg(
        F.sum("volume_closed_usd").cast("double").alias("vol"), F.sum("volume").alias("lot"), F.max("volume").alias("max_lot"),
        F.count("volume_closed_usd").alias("n"), F.count_if(F.col("volume") <= 100).alias("small"))


@query("counts", """
SELECT symbol, COUNT(*) AS n_rows, COUNT(close_time) AS n_closed, CAST(SUM(1) AS BIGINT) AS n_sum FROM fx_orders_mt4 GROUP BY symbol""")
def _(t):
    return t.fx_orders_mt4.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count("close_time").alias("n_closed"), F.sum(F.lit(1)).alias("n_sum"))


@query("cond_count", "SELECT symbol, COUNT(CASE WHEN profit_usd > 0 THEN 1 END) AS wins FROM fx_trades GROUP BY symbol")
def _(t):
    return t.fx_trades.groupBy("symbol").agg(F.count_if(F.col("profit_usd") > 0).alias("wins"))


@query("cond_sum", """
SELECT user_id, CAST(SUM(CASE WHEN operation_type = 'deposit' THEN operation_amount_usd ELSE 0 END) AS DOUBLE) AS dep,
  CAST(SUM(CASE WHEN operation_type = 'withdrawal' THEN -operation_amount_usd ELSE 0 END) AS DOUBLE) AS wd FROM fx_balance GROUP BY user_id""")
def _(t):
    amount = F.col("operation_amount_usd")

    def of(kind, value):
        return F.sum(F.when(F.col("operation_type") == kind, value).otherwise(0)).cast("double")

    return t.fx_balance.groupBy("user_id").agg(of("deposit", amount).alias("dep"), of("withdrawal", -amount).alias("wd"))


@query("count_distinct", "SELECT symbol, COUNT(DISTINCT user_id) AS users FROM fx_trades GROUP BY symbol")
def _(t):
    return t.fx_trades.groupBy("symbol").agg(F.count_distinct("user_id").alias("users"))


@query("cond_count_distinct", """
SELECT symbol, COUNT(DISTINCT CASE WHEN profit_usd < 0 THEN user_id || '-' || order_id END) AS losing, COUNT(DISTINCT user_id || '-' || order_id) AS total
FROM fx_trades GROUP BY symbol""")
def _(t):
    key = F.concat_ws("-", "user_id", "order_id")
    return t.fx_trades.groupBy("symbol").agg(F.count_distinct(F.when(F.col("profit_usd") < 0, key)).alias("losing"), F.count_distinct(key).alias("total"))


@query("net_vs_gross", """
WITH x AS (SELECT login, symbol, CASE WHEN action = 0 THEN volume ELSE -volume END AS v FROM fx_deals_mt5)
SELECT login, symbol, CAST(SUM(ABS(v)) AS DOUBLE) AS gross, CAST(ABS(SUM(v)) AS DOUBLE) AS net FROM x GROUP BY 1, 2 HAVING SUM(ABS(v)) != ABS(SUM(v))""")
def _(t):
    v = scalars.signed_volume(F.col("action"), F.col("volume"))
    agg = t.fx_deals_mt5.groupBy("login", "symbol").agg(F.sum(F.abs(v)).alias("gross"), F.abs(F.sum(v)).alias("net"))
    return as_double(agg.where("gross != net"))


@query("avg_null_skip", """
SELECT symbol, ROUND(AVG(CASE WHEN profit_usd > 0 THEN CAST(profit_usd AS DOUBLE) END), 4) AS avg_win FROM fx_trades GROUP BY symbol""")
def _(t):
    return t.fx_trades.groupBy("symbol").agg(dbl(F.avg(F.when(F.col("profit_usd") > 0, F.col("profit_usd").cast("double"))), 4).alias("avg_win"))


@query("min_max", "SELECT user_uid, MIN(open_time) AS first_time, MAX(close_time) AS last_time FROM fx_orders_mt4 GROUP BY user_uid")
def _(t):
    return t.fx_orders_mt4.groupBy("user_uid").agg(F.min("open_time").alias("first_time"), F.max("close_time").alias("last_time"))


@query("arg_max", """
SELECT login, position_id, entry, CAST(max_by(profit, (updated, version)) FILTER (profit IS NOT NULL) AS DOUBLE) AS profit,
  max_by(time_msc, (updated, version)) FILTER (time_msc IS NOT NULL) AS time_msc, max_by(version, (updated, version)) AS version
FROM fx_deals_extra GROUP BY 1, 2, 3""")
def _(t):
    return as_double(t.fx_deals_extra.groupBy("login", "position_id", "entry").agg(
        *[newest(c, "updated", "version").alias(c) for c in ("profit", "time_msc", "version")]))


@query("approx_percentile", """
SELECT symbol, COUNT(*) AS n, true AS within, true AS merged_within, true AS span_counts FROM fx_trades WHERE profit_usd IS NOT NULL GROUP BY symbol""")
def _(t):
    """Rank errors of sketches, made in one pass and merged from stored days, are within the bound; the days of a span add up."""
    qs, keys = [0.0, 0.2, 0.5, 0.8, 0.95, 1.0], ["symbol"]
    rows = materialize(t.fx_trades.select("symbol", "open_time", "profit_usd"), "trades")
    stored = materialize(sketches.day_sketches(rows, keys, "open_time", "profit_usd"), "sketches")
    once = sketches.percentiles(sketches.day_sketches(rows.withColumn("open_time", F.lit("2000-01-01")), keys, "open_time", "profit_usd"), keys, qs)
    days = sketches.percentiles(sketches.span_sketches(stored, keys), keys, qs)
    late = sketches.span_sketches(stored, keys, "1995-01-01", "1997-07-01").select("symbol", F.col("cnt").alias("late"))
    counted = rows.where("open_time >= '1995-01-01' AND open_time < '1997-07-01' AND profit_usd IS NOT NULL").groupBy("symbol").agg(n_rows().alias("true_late"))
    a, b = (sketches.rank_errors(rows, keys, "profit_usd", answers, qs) for answers in (once, days))
    joined = a.join(b.select("symbol", F.col("error").alias("merged_error")), "symbol").join(late, "symbol", "left").join(counted, "symbol", "left")
    bound = sketches.RANK_ERROR
    return joined.select("symbol", "n", (F.col("error") <= bound).alias("within"), (F.col("merged_error") <= bound).alias("merged_within"), F.col("late").eqNullSafe(F.col("true_late")).alias("span_counts"))


@query("approx_percentile_values")
def _(t):
    return approx_percentiles(t.fx_trades.select("symbol", F.col("profit_usd").cast("double").alias("v")), ["symbol"], "v", [0.80, 0.95])


@query("exact_percentile", """
SELECT symbol, ROUND(quantile_cont(CAST(profit_usd AS DOUBLE), 0.8), 6) AS p0, ROUND(quantile_cont(CAST(profit_usd AS DOUBLE), 0.975), 6) AS p1
FROM fx_trades GROUP BY symbol""")
def _(t):
    return as_double(exact_percentiles(t.fx_trades, ["symbol"], "profit_usd", [0.8, 0.975]))


@query("mean_median_std", """
SELECT ROUND(AVG(o_totalprice), 4) AS mean, ROUND(MEDIAN(o_totalprice), 4) AS median, ROUND(STDDEV_SAMP(o_totalprice), 4) AS std FROM orders""")
def _(t):
    one = t.orders.agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("std"))
    median = exact_percentiles(t.orders, [], "o_totalprice", [0.5]).scalar()
    return as_double(one.withColumn("median", median), 4)


@query("group_by_alias", """
SELECT regexp_replace(symbol, '[empkfzc]$', '') AS symbol_reg, year(open_time) AS y, COUNT(*) AS cnt FROM fx_trades GROUP BY 1, 2""")
def _(t):
    return as_long(t.spark.sql(
        "SELECT regexp_replace(symbol, '[empkfzc]$', '') AS symbol_reg, year(open_time) AS y, count(*) AS cnt FROM {trades} GROUP BY symbol_reg, y",
        trades=t.fx_trades), "y")


@query("having_alias", "SELECT login, COUNT(*) AS cnt FROM fx_responses GROUP BY login HAVING cnt > 30")
def _(t):
    return t.spark.sql("SELECT login, count(*) AS cnt FROM {r} GROUP BY login HAVING cnt > 30", r=t.fx_responses)


@query("two_level_agg", """
SELECT user_uid, ROUND(CAST(SUM(v) AS DOUBLE), 2) AS v, MAX(m) AS m, CAST(SUM(n) AS BIGINT) AS n FROM (
  SELECT user_uid, CAST(SUM(volume_closed_usd) AS DECIMAL(30,2)) AS v, CAST(MAX(volume) AS DOUBLE) AS m, COUNT(*) AS n FROM fx_orders_mt4 GROUP BY 1
  UNION ALL SELECT user_uid, CAST(SUM(volume_closed_usd) AS DECIMAL(30,2)), CAST(MAX(volume_closed) AS DOUBLE), COUNT(*) FROM fx_deals_mt5 GROUP BY 1) GROUP BY 1""")
def _(t):
    rows = t.fx_orders_mt4.select("user_uid", "volume_closed_usd", F.col("volume").cast("double").alias("m")).union(
        t.fx_deals_mt5.select("user_uid", "volume_closed_usd", F.col("volume_closed").cast("double")))
    return rows.groupBy("user_uid").agg(dbl(F.sum("volume_closed_usd"), 2).alias("v"), F.max("m").alias("m"), n_rows().alias("n"))


@query("global_agg", "SELECT COUNT(*) AS cnt, CAST(SUM(amount) AS DOUBLE) AS total FROM fx_loans")
def _(t):
    return t.fx_loans.agg(n_rows().alias("cnt"), F.sum("amount").cast("double").alias("total"))


@query("agg_ratio", """
SELECT login, ROUND(SUM(CASE WHEN response_result = 2 THEN 1 ELSE 0 END)::DOUBLE / SUM(1), 6) AS share FROM fx_responses GROUP BY login""")
def _(t):
    return t.fx_responses.groupBy("login").agg(dbl(scalars.ratio(F.count_if(F.col("response_result") == 2), n_rows())).alias("share"))


@query("value_counts", "SELECT tax_system, COUNT(*) AS cnt FROM fx_companies GROUP BY tax_system")
def _(t):
    return aggregates.value_counts(t.fx_companies, "tax_system")


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, ROUND(corr({a}, {b}), 6) AS corr FROM lineitem" for a in CORR for b in CORR))
def _(t):
    return as_double(aggregates.corr_matrix(t.lineitem, CORR))


@query("corr_with", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, ROUND(corr({a}, l_extendedprice), 6) AS corr FROM lineitem" for a in ("l_quantity", "l_discount", "l_tax")))
def _(t):
    return as_double(aggregates.corr_with(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query("describe_frame", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, COUNT({c}) AS count, COUNT(*) - COUNT({c}) AS nulls, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,
  MIN({c})::DOUBLE AS min, ROUND(quantile_cont({c}, 0.25), 4) AS q25, ROUND(quantile_cont({c}, 0.5), 4) AS q50, ROUND(quantile_cont({c}, 0.75), 4) AS q75, MAX({c})::DOUBLE AS max
FROM (SELECT l_quantity, CASE WHEN l_tax > 0 THEN l_tax END AS l_tax, l_extendedprice FROM lineitem)""" for c in ("l_quantity", "l_tax", "l_extendedprice")))
def _(t):
    rows = t.lineitem.withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return as_double(aggregates.describe_columns(rows, ["l_quantity", "l_tax", "l_extendedprice"]), 4)


@query("histogram", """
WITH b AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders)
SELECT o_orderstatus, CAST(LEAST(floor((o_totalprice - lo) / ((hi - lo) / 30.0)), 29) AS INT) AS bin, COUNT(*) AS cnt FROM orders CROSS JOIN b GROUP BY 1, 2""")
def _(t):
    return aggregates.histogram(t.orders, "o_totalprice", 30, ["o_orderstatus"])


@query("box_stats", """
WITH q AS (
  SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
  FROM orders GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence FROM q)
SELECT f.o_orderstatus, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3, ROUND(low_fence, 4) AS low_fence, ROUND(high_fence, 4) AS high_fence,
  COUNT(CASE WHEN o_totalprice < low_fence OR o_totalprice > high_fence THEN 1 END) AS outliers
FROM f JOIN orders o ON o.o_orderstatus = f.o_orderstatus GROUP BY ALL""")
def _(t):
    return as_double(aggregates.box_stats(t.orders, "o_totalprice", ["o_orderstatus"]), 4)


PAPERS = [f"Brand#{i}" for i in range(1, 26)]


@query("pivot_sum", f"""
WITH {PLAN_CTES}
SELECT date, {', '.join(f"CAST(SUM(CASE WHEN paper = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS {p.replace('#', '_')}" for p in PAPERS)} FROM plan GROUP BY date""")
def _(t):
    wide = aggregates.pivot_sum(_ledger(t), "date", "paper", "lots", PAPERS)
    return wide.toDF("date", *[p.replace("#", "_") for p in PAPERS])


@query("group_means", "SELECT label, " + ", ".join(f"ROUND(AVG(CAST(embedding[{i + 1}] AS DOUBLE)), 6) AS x{i}" for i in range(len(IRIS))) + " FROM embeddings GROUP BY label")
def _(t):
    return as_double(iris(t).groupBy("label").agg(*[F.avg(c).alias(c) for c in IRIS]))


@query("stats_all_and_class", """
WITH x AS (SELECT o_orderstatus AS class, 'o_totalprice' AS variable, o_totalprice AS value FROM orders
           UNION ALL SELECT o_orderstatus, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders),
g AS (SELECT CASE WHEN GROUPING(class) = 1 THEN 'all' ELSE class END AS class, variable, AVG(value) AS mean, MEDIAN(value) AS median, STDDEV_SAMP(value) AS std
      FROM x GROUP BY GROUPING SETS ((variable), (variable, class)))
SELECT class, variable, statistic, ROUND(value, 4) AS value FROM (UNPIVOT g ON mean, median, std INTO NAME statistic VALUE value)""")
def _(t):
    return as_double(aggregates.class_stats(t.orders, ["o_totalprice", "o_custkey"], "o_orderstatus"), 4)


@query("month_sum", "SELECT CAST(month(date_begin) AS INT) AS month, CAST(SUM(amount) AS DOUBLE) AS amount FROM fx_loans GROUP BY 1")
def _(t):
    return as_double(loans.issued_by_month(t.fx_loans), 2)


@query("latest_per_day", """
SELECT uid, CAST(updated AS DATE) AS updated_day, arg_max(muslim, (updated, seq)) AS muslim, arg_max(status, (updated, seq)) AS status FROM fx_swap_profiles GROUP BY 1, 2""")
def _(t):
    return aggregates.latest_per_day(t.fx_swap_profiles, "uid", "updated", "seq", ["muslim", "status"])


@query("max_dedupe", """
SELECT user_uid, trading_date, MAX(client_value_segment_ccode) AS segment FROM fx_segments
WHERE trading_date >= DATE '1997-01-01' AND client_value_segment_ccode IN ('0','1','2','3','4','5') GROUP BY 1, 2""")
def _(t):
    return risk.daily_segments(t.fx_segments, "1997-01-01")


@query("unique_sorted", "SELECT DISTINCT CAST(year(date) * 100 + month(date) AS INT) AS month_id FROM fx_prices")
def _(t):
    return t.fx_prices.select(scalars.yyyymm(F.col("date")).alias("month_id")).distinct().orderBy("month_id")


@query("dividends_by", """
SELECT CAST((year(date) * 100 + month(date)) // 100 AS INT) AS year, tiker, CAST(SUM(dividend) AS DOUBLE) AS dividend FROM fx_dividends GROUP BY 1, 2""")
def _(t):
    rows = portfolio.with_month(t.fx_dividends).drop("year").withColumn("year", scalars.year_of(F.col("month_id")))
    return as_double(rows.groupBy("year", "tiker").agg(F.sum("dividend").alias("dividend")))
