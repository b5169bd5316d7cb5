"""Window functions, in the forms that survive a hot key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook import constants
from tidebook.catalog.registry import as_double, dbl, query
from tidebook.catalog.reports import PLAN_CTES, _ledger
from tidebook.operators import windows
from tidebook.operators.aggregates import top_with_ties
from tidebook.plans import portfolio, rejects, users

REJECT = constants.REJECT_COMMENT


@query("first_row_dedupe", """
SELECT user_id, country_code, registration_time FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY registration_time) AS rn FROM fx_users) WHERE rn = 1""")
def _(t):
    return users.registrations(t.fx_users)


@query("first_event", """
SELECT user_id, order_id, line_no, open_time FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY open_time, close_time, order_id, line_no, profit_usd) AS rn FROM fx_trades) WHERE rn = 1""")
def _(t):
    return windows.first_row(t.fx_trades, ["user_id"], users.TRADE_ORDER, ["order_id", "line_no", "open_time"])


@query("rank_in_group_agg", """
SELECT user_id, operation_time, amount FROM (
  SELECT user_id, operation_time, CAST(SUM(operation_amount_usd) AS DOUBLE) AS amount, rank() OVER (PARTITION BY user_id ORDER BY operation_time) AS r
  FROM fx_balance WHERE operation_type = 'deposit' GROUP BY user_id, operation_time) WHERE r = 1""")
def _(t):
    sums = t.fx_balance.where("operation_type = 'deposit'").groupBy("user_id", "operation_time").agg(
        F.sum("operation_amount_usd").cast("double").alias("amount"))
    return windows.first_row(sums, ["user_id"], ["operation_time"], ["operation_time", "amount"])


@query("rank_global_agg", """
SELECT user_id, total FROM (
  SELECT user_id, CAST(SUM(profit_usd) AS DOUBLE) AS total, rank() OVER (ORDER BY SUM(profit_usd) DESC) AS r FROM fx_trades GROUP BY user_id) WHERE r = 1""")
def _(t):
    return as_double(top_with_ties(t.fx_trades.groupBy("user_id").agg(F.sum("profit_usd").alias("total")), "total"), 4)


@query("first_value_by_agg", """
SELECT DISTINCT user_id, first_value(symbol) OVER (PARTITION BY user_id ORDER BY SUM(profit_usd), symbol) AS symbol_loss,
  first_value(symbol) OVER (PARTITION BY user_id ORDER BY SUM(profit_usd) DESC, symbol) AS symbol_profit,
  first_value(symbol) OVER (PARTITION BY user_id ORDER BY COUNT(profit_usd) DESC, symbol) AS symbol_populare FROM fx_trades GROUP BY user_id, symbol""")
def _(t):
    return users.trader_totals(t.fx_trades).select("user_id", "symbol_loss", "symbol_profit", "symbol_populare")


@query("row_number_by_count", """
SELECT uuid, cnt, CAST(rn AS INT) AS rn FROM (
  SELECT uuid, COUNT(*) AS cnt, row_number() OVER (ORDER BY COUNT(*) DESC, uuid) AS rn FROM fx_responses
  WHERE comment = 'margin no money (precheck)' GROUP BY uuid) WHERE rn <= 20""")
def _(t):
    return rejects.top_rejected(t.fx_responses, 20)


@query("running_sum_rows", """
SELECT op_id, user_id, CAST(SUM(operation_amount_usd) OVER (PARTITION BY user_id ORDER BY operation_time, op_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total,
  CAST(SUM(operation_amount_usd) OVER (PARTITION BY user_id, operation_type ORDER BY operation_time, op_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total_of_type
FROM fx_balance""")
def _(t):
    amount = F.col("operation_amount_usd")
    out = windows.running_sums(
        t.fx_balance, {"total": (["user_id"], amount), "total_of_type": (["user_id", "operation_type"], amount)},
        ["operation_time", "op_id"])
    return as_double(out.select("op_id", "user_id", "total", "total_of_type"), 2)


@query("running_sum_range", """
SELECT op_id, user_id, CAST(SUM(operation_amount_usd) OVER (PARTITION BY user_id ORDER BY operation_time) AS DOUBLE) AS total FROM fx_balance""")
def _(t):
    out = windows.running_sums(
        t.fx_balance, {"total": (["user_id"], F.col("operation_amount_usd"))}, ["operation_time"], "range")
    return as_double(out.select("op_id", "user_id", "total"), 2)


@query("lag_prev", """
SELECT event_id, lag(comment) OVER (PARTITION BY uuid, login ORDER BY request_ts, event_id) AS prev_comment FROM fx_responses""")
def _(t):
    return windows.previous_value(
        t.fx_responses, ["uuid", "login"], ["request_ts", "event_id"], "comment", "prev_comment"
    ).select("event_id", "prev_comment")


@query("cond_true_event", """
SELECT event_id, CAST(SUM(CASE WHEN response_result = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY login ORDER BY request_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step
FROM fx_responses""")
def _(t):
    return windows.conditional_event_counter(
        t.fx_responses, ["login"], ["request_ts", "event_id"], F.col("response_result") == 2, "step").select("event_id", "step")


@query("repeat_incidents", """
WITH b AS (SELECT *, lag(comment) OVER (PARTITION BY uuid, login ORDER BY request_ts, event_id) AS prev FROM fx_responses)
SELECT event_id, CAST(SUM(CASE WHEN comment = prev AND comment = 'margin no money (precheck)' THEN 1 ELSE 0 END)
  OVER (PARTITION BY uuid, login ORDER BY request_ts) AS BIGINT) AS incidents FROM b""")
def _(t):
    keys, order = ["uuid", "login"], ["request_ts", "event_id"]
    rows = windows.previous_value(t.fx_responses, keys, order, "comment", "prev")
    hit = (F.col("comment") == F.col("prev")) & (F.col("comment") == REJECT)
    step = F.coalesce(hit, F.lit(False)).cast("bigint")
    return windows.running_sums(rows, {"incidents": (keys, step)}, ["request_ts"], "range").select("event_id", "incidents")


@query("cum_investment", f"""
WITH {PLAN_CTES}, m AS (SELECT month_id, SUM(price) AS spent FROM plan GROUP BY 1)
SELECT month_id, CAST(SUM(spent) OVER (ORDER BY month_id) AS DOUBLE) AS invested FROM m""")
def _(t):
    # One row per month reaches the window.
    months = _ledger(t).groupBy("month_id").agg(F.sum("price").alias("spent"))
    upto = Window.orderBy("month_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return as_double(months.select("month_id", F.sum("spent").over(upto).alias("invested")), 4)


@query("cum_holdings", f"""
WITH {PLAN_CTES}
SELECT paper, month_id, CAST(SUM(1) OVER (PARTITION BY paper ORDER BY month_id) AS BIGINT) AS held FROM plan""")
def _(t):
    return portfolio.cumulative_holdings(_ledger(t)).select("paper", "month_id", "held")
