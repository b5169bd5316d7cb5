"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook import constants
from tidebook.catalog.registry import as_double, dbl, query
from tidebook.functions import scalars
from tidebook.operators import joins, windows
from tidebook.operators.aggregates import latest_per_day, newest, top_with_ties
from tidebook.plans import loans, portfolio, rejects, risk


@query("inner_two_key", """
WITH c AS (SELECT login, position_id, MAX(time_msc) AS closed_at FROM fx_deals_extra WHERE entry = 1 GROUP BY 1, 2),
o AS (SELECT login, position_id, MIN(time_msc) AS opened_at FROM fx_deals_extra WHERE entry = 0 GROUP BY 1, 2)
SELECT c.login, c.position_id, date_diff('second', opened_at, closed_at) AS duration FROM c JOIN o ON o.login = c.login AND o.position_id = c.position_id""")
def _(t):
    legs = t.fx_deals_extra
    close = legs.where("entry = 1").groupBy("login", "position_id").agg(F.max("time_msc").alias("closed_at"))
    opened = legs.where("entry = 0").groupBy("login", "position_id").agg(F.min("time_msc").alias("opened_at"))
    return close.join(opened, ["login", "position_id"]).select(
        "login", "position_id", scalars.seconds_between(F.col("opened_at"), F.col("closed_at")).alias("duration"))


@query("left_computed_key", """
WITH s AS (SELECT user_uid, trading_date, MAX(client_value_segment_ccode) AS segment FROM fx_segments
           WHERE client_value_segment_ccode IN ('0','1','2','3','4','5') GROUP BY 1, 2)
SELECT o.order_id, s.segment FROM fx_orders_mt4 o LEFT JOIN s ON s.user_uid = o.user_uid AND s.trading_date = CAST(o.open_time AS DATE)""")
def _(t):
    seg = risk.daily_segments(t.fx_segments, "1990-01-01").withColumnRenamed("user_uid", "seg_user")
    on = (F.col("seg_user") == F.col("user_uid")) & (F.col("trading_date") == F.to_date("open_time"))
    return t.fx_orders_mt4.join(seg, on, "left").select("order_id", "segment")


@query("left_dim", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(t):
    rich = t.customer.where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return t.orders.join(rich, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("left_star", """
WITH u AS (SELECT DISTINCT user_id FROM fx_users),
a AS (SELECT user_id, COUNT(*) AS trades FROM fx_trades GROUP BY 1), b AS (SELECT user_id, COUNT(*) AS ops FROM fx_balance GROUP BY 1),
d AS (SELECT user_id, CAST(SUM(operation_amount_usd) AS DOUBLE) AS dep FROM fx_balance WHERE operation_type = 'deposit' GROUP BY 1)
SELECT u.user_id, trades, ops, dep FROM u LEFT JOIN a ON a.user_id = u.user_id LEFT JOIN b ON b.user_id = u.user_id LEFT JOIN d ON d.user_id = u.user_id""")
def _(t):
    trades = t.fx_trades.groupBy("user_id").agg(F.count(F.lit(1)).alias("trades"))
    deposit = F.when(F.col("operation_type") == "deposit", F.col("operation_amount_usd"))
    ops = t.fx_balance.groupBy("user_id").agg(F.count(F.lit(1)).alias("ops"), F.sum(deposit).cast("double").alias("dep"))
    return t.fx_users.select("user_id").distinct().join(trades, "user_id", "left").join(ops, "user_id", "left")


@query("left_on_rank", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY operation_time, op_id) AS rn FROM fx_balance)
SELECT u.user_id, f.op_id FROM (SELECT DISTINCT user_id FROM fx_users) u LEFT JOIN f ON f.user_id = u.user_id AND f.rn = 1""")
def _(t):
    first = windows.first_row(t.fx_balance, ["user_id"], ["operation_time", "op_id"], ["op_id"])
    return t.fx_users.select("user_id").distinct().join(first, "user_id", "left")


@query("range_interval", """
SELECT b.user_id, COUNT(*) AS cnt, CAST(SUM(operation_amount_usd) AS DOUBLE) AS total FROM fx_balance b
JOIN fx_users u ON u.user_id = b.user_id AND u.registration_time + INTERVAL 30 DAY >= b.operation_time GROUP BY b.user_id""")
def _(t):
    until = (F.col("registration_time").cast("timestamp_ntz") + F.expr("INTERVAL 30 DAYS")).alias("until")
    joined = t.fx_balance.join(t.fx_users.select("user_id", until), "user_id").where(F.col("until") >= F.col("operation_time"))
    return joined.groupBy("user_id").agg(F.count(F.lit(1)).alias("cnt"), F.sum("operation_amount_usd").cast("double").alias("total"))


@query("left_then_notnull", """
SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 JOIN nation ON n_nationkey = c_nationkey""")
def _(t):
    rich = t.customer.where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    return (t.orders.join(rich, F.col("c_custkey") == F.col("o_custkey"), "left")
            .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").where("n_nationkey IS NOT NULL").select("o_orderkey", "n_name"))


@query("three_key_join", """
SELECT c.symbol, COUNT(*) AS cnt, CAST(SUM(q.value * c.volume_lots) AS DOUBLE) AS cost
FROM fx_charged_swaps c JOIN fx_swap_quotes q ON q.dt = c.date AND q.symbol = c.symbol AND q.side = CASE WHEN c.action = 0 THEN 'Ask' ELSE 'Bid' END
GROUP BY c.symbol""")
def _(t):
    side = F.when(F.col("action") == 0, F.lit("Ask")).otherwise(F.lit("Bid"))
    daily = t.fx_charged_swaps.groupBy(F.col("date").alias("dt"), "symbol", side.alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume_lots").alias("lots"))
    priced = daily.join(t.fx_swap_quotes, ["dt", "symbol", "side"])
    return priced.groupBy("symbol").agg(F.sum("n").alias("cnt"), F.sum(F.col("value").cast("decimal(9,4)") * F.col("lots")).cast("double").alias("cost"))


@query("inner_rank_limit", """
WITH w AS (SELECT uuid, row_number() OVER (ORDER BY COUNT(*) DESC, uuid) AS rn FROM fx_responses WHERE comment = 'margin no money (precheck)' GROUP BY uuid)
SELECT r.event_id, CAST(w.rn AS INT) AS rn FROM fx_responses r JOIN w ON w.uuid = r.uuid AND w.rn < 20""")
def _(t):
    top = rejects.top_rejected(t.fx_responses, 19).select("uuid", "rn")
    return t.fx_responses.join(top, "uuid").select("event_id", "rn")


@query("semi_in", "SELECT login, COUNT(*) AS cnt FROM fx_deals_extra WHERE login IN (SELECT code FROM fx_account_dim) GROUP BY login")
def _(t):
    return joins.in_keys(t.fx_deals_extra, "login", t.fx_account_dim).groupBy("login").agg(F.count(F.lit(1)).alias("cnt"))


@query("in_or_list", """
SELECT login, COUNT(*) AS cnt FROM fx_deals_extra WHERE login IN (SELECT code FROM fx_account_dim) OR login IN (10, 30, 40, 110) GROUP BY login""")
def _(t):
    return joins.in_keys(t.fx_deals_extra, "login", t.fx_account_dim, (10, 30, 40, 110)).groupBy("login").agg(F.count(F.lit(1)).alias("cnt"))


@query("scalar_subquery", """
WITH s AS (SELECT user_id, SUM(profit_usd) AS p FROM fx_trades GROUP BY 1)
SELECT symbol, CAST(SUM(profit_usd) AS DOUBLE) AS profit FROM fx_trades WHERE user_id IN (SELECT user_id FROM s WHERE p = (SELECT MAX(p) FROM s)) GROUP BY symbol""")
def _(t):
    best = top_with_ties(t.fx_trades.groupBy("user_id").agg(F.sum("profit_usd").alias("p")), "p").select("user_id")
    return t.fx_trades.join(best, "user_id", "left_semi").groupBy("symbol").agg(F.sum("profit_usd").cast("double").alias("profit"))


@query("anti_isin", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(big, "c_custkey", "left_anti")


@query("merge_diff_names", "SELECT tiker, date, CAST(dividend AS DOUBLE) AS dividend, stock_in_lot FROM fx_dividends JOIN fx_lots ON tiker = stock")
def _(t):
    return as_double(t.fx_dividends.join(t.fx_lots, F.col("tiker") == F.col("stock")).drop("stock"))


@query("lookup_price", """
WITH d AS (SELECT tiker, CAST(year(date) * 100 + month(date) AS INT) AS month_id, CAST(SUM(dividend) AS DOUBLE) AS dividend FROM fx_dividends GROUP BY 1, 2)
SELECT p.paper, p.date, CAST(p.close * l.stock_in_lot AS DOUBLE) AS price, d.dividend FROM fx_prices p JOIN fx_lots l ON l.stock = p.paper
LEFT JOIN d ON d.tiker = p.paper AND d.month_id = year(p.date) * 100 + month(p.date)""")
def _(t):
    due = t.fx_dividends.groupBy(F.col("tiker").alias("paper"), scalars.yyyymm(F.col("date")).alias("month_id")).agg(F.sum("dividend").alias("dividend"))
    return as_double(portfolio.lot_prices(t.fx_prices, t.fx_lots).join(due, ["paper", "month_id"], "left").select("paper", "date", "price", "dividend"))


@query("suffix_expand", """
SELECT symbol || s AS full_symbol, dt, side, CAST(value AS DOUBLE) AS value FROM fx_swap_quotes CROSS JOIN (VALUES ('m'),('c'),('z'),('r'),('p'),('e'),('')) x(s)""")
def _(t):
    return as_double(joins.expand_suffixes(t.fx_swap_quotes, "symbol", constants.QUOTE_SUFFIXES, "full_symbol").drop("symbol"))


@query("date_spine", """
WITH d AS (SELECT date_begin, SUM(amount) AS amount FROM fx_loans GROUP BY 1)
SELECT CAST(s.day AS DATE) AS day, CAST(COALESCE(amount, 0) AS DOUBLE) AS amount
FROM (SELECT unnest(generate_series(MIN(date_begin), MAX(date_begin), INTERVAL 1 DAY)) AS day FROM fx_loans) s LEFT JOIN d ON d.date_begin = s.day""")
def _(t):
    return as_double(loans.issued_by_day(t.fx_loans))


@query("union_all_positional", """
SELECT user_uid, CAST(volume_usd AS DOUBLE) AS volume FROM fx_deals_mt5 UNION ALL SELECT user_uid, CAST(volume_opened_usd AS DOUBLE) FROM fx_orders_mt4""")
def _(t):
    deals = t.fx_deals_mt5.select("user_uid", F.col("volume_usd").cast("double").alias("volume"))
    return deals.union(t.fx_orders_mt4.select("user_uid", F.col("volume_opened_usd").cast("double")))


@query("union_ctes", """
WITH a AS (SELECT user_uid, symbol, CAST(SUM(volume_opened_usd) AS DOUBLE) AS v FROM fx_orders_mt4 WHERE open_time < TIMESTAMP '1997-01-01' GROUP BY 1, 2),
b AS (SELECT user_uid, symbol, CAST(volume_opened_usd AS DOUBLE) AS v FROM fx_orders_mt4 WHERE open_time >= TIMESTAMP '1997-01-01')
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _(t):
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    before = t.fx_orders_mt4.where(F.col("open_time") < cut).groupBy("user_uid", "symbol").agg(F.sum("volume_opened_usd").cast("double").alias("v"))
    later = t.fx_orders_mt4.where(F.col("open_time") >= cut).select("user_uid", "symbol", F.col("volume_opened_usd").cast("double").alias("v"))
    return before.union(later)


@query("append_frames", """
SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def _(t):
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return suppliers.unionByName(customers, allowMissingColumns=True)


@query("set_difference", """
WITH e AS (SELECT paper FROM fx_prices GROUP BY paper HAVING MAX(close) < 104000),
n AS (SELECT stock AS paper FROM fx_lots EXCEPT SELECT paper FROM e), x AS (SELECT DISTINCT tiker AS paper FROM fx_dividends WHERE dividend > 0.07)
SELECT DISTINCT paper FROM (SELECT * FROM n UNION ALL SELECT * FROM x)""")
def _(t):
    cheap = t.fx_prices.groupBy("paper").agg(F.max("close").alias("top")).where("top < 104000").select("paper")
    rest = t.fx_lots.select(F.col("stock").alias("paper")).join(cheap, "paper", "left_anti")
    paying = t.fx_dividends.where("dividend > 0.07").select(F.col("tiker").alias("paper"))
    return rest.union(paying).distinct()
