"""Projections, filters, predicates and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import as_double, dbl, query
from tidebook.functions import scalars, text
from tidebook.operators import clean, windows
from tidebook.plans import churn


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


@query("project_alias", "SELECT user_uid AS user, symbol, open_time AS deal_time FROM fx_trades_extra")
def _(t):
    return t.fx_trades_extra.select(F.col("user_uid").alias("user"), "symbol", F.col("open_time").alias("deal_time"))


@query("select_star_plus", "SELECT *, n_nationkey * 10 + n_regionkey AS code FROM nation")
def _(t):
    return t.nation.select("*", (F.col("n_nationkey") * 10 + F.col("n_regionkey")).alias("code"))


@query("drop_rename", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def _(t):
    return t.customer.drop("c_name", "c_nationkey", "c_acctbal").withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "segment"})


@query("case_searched", """
SELECT CASE WHEN entry = 0 AND action = 0 THEN 'buy' WHEN entry = 0 AND action = 1 THEN 'sell' WHEN entry = 1 AND action = 0 THEN 'sell'
            WHEN entry = 1 AND action = 1 THEN 'buy' END AS direction, entry, action, COUNT(*) AS cnt FROM fx_deals_mt5 GROUP BY 1, 2, 3""")
def _(t):
    way = scalars.deal_direction(F.col("entry"), F.col("action")).alias("direction")
    return t.fx_deals_mt5.select(way, "entry", "action").groupBy("direction", "entry", "action").agg(F.count(F.lit(1)).alias("cnt"))


@query("case_null", "SELECT op_id, CAST(CASE WHEN operation_type = 'deposit' THEN operation_amount_usd END AS DOUBLE) AS deposit FROM fx_balance")
def _(t):
    return t.fx_balance.select("op_id", dbl(F.when(F.col("operation_type") == "deposit", F.col("operation_amount_usd"))).alias("deposit"))


@query("signed_volume", """
SELECT login, CAST(SUM(CASE WHEN action = 0 THEN volume WHEN action = 1 THEN -volume END) AS DOUBLE) AS net FROM fx_deals_mt5 GROUP BY login""")
def _(t):
    return t.fx_deals_mt5.groupBy("login").agg(F.sum(scalars.signed_volume(F.col("action"), F.col("volume"))).cast("double").alias("net"))


@query("const_tag", "SELECT 'mt4' AS mt, order_id, TIMESTAMP '2022-01-10 23:59:00' AS date_deal, 0 AS start_profit FROM fx_orders_mt4")
def _(t):
    return t.fx_orders_mt4.select(F.lit("mt4").alias("mt"), "order_id", _ts("2022-01-10 23:59:00").alias("date_deal"), F.lit(0).alias("start_profit"))


@query("range_half_open", """
SELECT order_id, open_time FROM fx_orders_mt4 WHERE date_trunc('day', open_time) >= TIMESTAMP '1997-01-01' AND date_trunc('day', open_time) < TIMESTAMP '1998-01-01'""")
def _(t):
    return t.fx_orders_mt4.where((F.col("open_time") >= _ts("1997-01-01")) & (F.col("open_time") < _ts("1998-01-01"))).select("order_id", "open_time")


@query("date_offset_window", "SELECT DISTINCT user_uid, position_id, date FROM fx_deals_extra WHERE date >= DATE '1998-06-02' - 30 AND date < DATE '1998-06-02'")
def _(t):
    day = F.lit("1998-06-02").cast("date")
    return t.fx_deals_extra.where((F.col("date") >= F.date_sub(day, 30)) & (F.col("date") < day)).select("user_uid", "position_id", "date").distinct()


@query("in_list", "SELECT order_id, cmd FROM fx_orders_mt4 WHERE cmd IN (0, 2, 4) AND symbol NOT IN ('SYM0', 'SYM1')")
def _(t):
    return t.fx_orders_mt4.where(F.col("cmd").isin(0, 2, 4) & ~F.col("symbol").isin("SYM0", "SYM1")).select("order_id", "cmd")


@query("like_filter", "SELECT comment, COUNT(*) AS cnt FROM fx_deals_mt5 WHERE comment LIKE '[so%' OR comment LIKE 'D-NULL' GROUP BY comment")
def _(t):
    kept = t.fx_deals_mt5.where(F.col("comment").like("[so%") | F.col("comment").like("D-NULL"))
    return kept.groupBy("comment").agg(F.count(F.lit(1)).alias("cnt"))


@query("ci_like", "SELECT order_id, server FROM fx_orders_mt4 WHERE lower(server) LIKE '%real%'")
def _(t):
    return t.fx_orders_mt4.where(F.col("server").ilike("%REAL%")).select("order_id", "server")


@query("null_3vl", """
SELECT order_id, comment FROM fx_trades_extra WHERE (comment NOT LIKE 'close hedge by%' OR comment IS NULL) AND close_time IS NOT NULL""")
def _(t):
    kept = ~F.col("comment").like("close hedge by%") | F.col("comment").isNull()
    return t.fx_trades_extra.where(kept & F.col("close_time").isNotNull()).select("order_id", "comment")


@query("between", "SELECT order_id, CAST(profit AS DOUBLE) AS profit FROM fx_trades_extra WHERE profit BETWEEN -0.01 AND 0")
def _(t):
    return as_double(t.fx_trades_extra.where(F.col("profit").between(-0.01, 0)).select("order_id", "profit"))


@query("neq_cols", "SELECT symbol, COUNT(*) AS cnt FROM fx_deals_mt5 WHERE symbol_ask != symbol_bid GROUP BY symbol")
def _(t):
    return t.fx_deals_mt5.where(F.col("symbol_ask") != F.col("symbol_bid")).groupBy("symbol").agg(F.count(F.lit(1)).alias("cnt"))


@query("nonempty_str", "SELECT event_id, comment FROM fx_responses WHERE comment != ''")
def _(t):
    return t.fx_responses.where(F.nullif("comment", F.lit("")).isNotNull()).select("event_id", "comment")


@query("contains_all", """
SELECT id, tax_system FROM fx_companies WHERE (tax_system LIKE '%USN%' AND tax_system LIKE '%ENVD%') OR (tax_system LIKE '%rashod%' AND tax_system NOT LIKE '%ENVD%')""")
def _(t):
    has = F.col("tax_system").contains
    return t.fx_companies.where((has("USN") & has("ENVD")) | (has("rashod") & ~has("ENVD"))).select("id", "tax_system")


@query("contains_none", "SELECT page_id, url FROM pages WHERE url NOT LIKE '%page=2%' AND url NOT LIKE '%/en/%' AND url NOT LIKE '%ref=%'")
def _(t):
    return t.pages.where(text.contains_none(F.col("url"), ["page=2", "/en/", "ref="])).select("page_id", "url")


@query("masked_assign", """
SELECT id, CASE WHEN tax_system LIKE '%ENVD%' AND tax_system LIKE '%USN%' THEN 'usn_envd' WHEN tax_system LIKE '%rashodov%' THEN 'usn_rashod'
  WHEN tax_system = 'ENVD' THEN 'envd' WHEN tax_system = 'OSNO' THEN 'osno' ELSE 'usn_dohod' END AS tax_class FROM fx_companies""")
def _(t):
    labels = {"osno": "OSNO", "envd": "ENVD", "usn": "USN", "expense": "rashodov"}
    return t.fx_companies.select("id", churn.tax_class(F.col("tax_system"), labels).alias("tax_class"))


@query("sentinel_replace", """
SELECT id, CASE WHEN org_creation_date < DATE '2000-01-01' THEN (SELECT MAX(org_creation_date) FROM fx_companies) ELSE org_creation_date END AS org_creation_date
FROM fx_companies""")
def _(t):
    return clean.sentinel_to_max(t.fx_companies, "org_creation_date", F.lit("2000-01-01").cast("date")).select("id", "org_creation_date")


@query("clip_upper", """
SELECT id, CAST(CASE WHEN date_diff('day', regdt, DATE '2016-06-01') >= 5000 THEN 5000 ELSE date_diff('day', regdt, DATE '2016-06-01') END AS INT) AS days FROM fx_companies""")
def _(t):
    days = F.date_diff(F.lit("2016-06-01").cast("date"), "regdt")
    return t.fx_companies.select("id", clean.clip_upper(days, 5000).alias("days"))


@query("fill_const", "SELECT order_id, COALESCE(comment, 'none') AS comment FROM fx_trades_extra")
def _(t):
    return t.fx_trades_extra.select("order_id", "comment").fillna("none", subset=["comment"])


@query("fill_mean", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus != 'P' THEN o_totalprice END AS price FROM orders)
SELECT o_orderkey, ROUND(COALESCE(price, (SELECT AVG(price) FROM x)), 4) AS price FROM x""")
def _(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    return as_double(clean.fill_mean(rows, ["price"]), 4)


@query("patch_cell", "SELECT c_custkey, CASE WHEN c_custkey = 143 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") != 143, F.col("c_acctbal")).alias("c_acctbal"))


@query("drop_null", "SELECT id, regdt FROM fx_companies WHERE regdt IS NOT NULL")
def _(t):
    return t.fx_companies.select("id", "regdt").dropna()


@query("zscore_filter", """
WITH s AS (SELECT AVG(o_totalprice) AS m, STDDEV_SAMP(o_totalprice) AS s FROM orders)
SELECT o_orderkey, o_totalprice FROM orders CROSS JOIN s WHERE ABS((o_totalprice - m) / s) < 1.5""")
def _(t):
    return clean.zscore_filter(t.orders, "o_totalprice", 1.5).select("o_orderkey", "o_totalprice")


@query("cast_types", """
SELECT event_id, CAST(uuid AS BIGINT) AS user_id, CAST(request_ts AS DATE) AS day, CAST(value AS INT) AS whole,
  TRY_CAST(comment AS DOUBLE) AS bad, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS same FROM (SELECT * REPLACE (floor(value) AS value) FROM fx_responses)""")
def _(t):
    whole = F.floor("value")
    return t.fx_responses.select(
        "event_id", F.col("uuid").cast("bigint").alias("user_id"), F.col("request_ts").cast("date").alias("day"), whole.cast("int").alias("whole"),
        F.col("comment").try_cast("double").alias("bad"), whole.cast("string").cast("double").alias("same"))


@query("bool_mask", "SELECT loan_id, term_months FROM fx_loans WHERE term_months > 50 AND interest_rate_effect < 7")
def _(t):
    return t.fx_loans.filter((F.col("term_months") > 50) & (F.col("interest_rate_effect") < 7)).select("loan_id", "term_months")


@query("lateral_alias", """
SELECT login, SUM(CASE WHEN response_result = 2 THEN 1 ELSE 0 END)::BIGINT AS resets, COUNT(*) AS requests, ROUND(resets / requests, 6) AS share
FROM fx_responses GROUP BY login""")
def _(t):
    return t.spark.sql(
        "SELECT login, count_if(response_result = 2) AS resets, count(*) AS requests, round(resets / requests, 6) AS share FROM {r} GROUP BY login",
        r=t.fx_responses)


@query("ratio_guard", """
SELECT order_id, CASE WHEN volume != 0 THEN CAST(profit_usd AS DOUBLE) / volume ELSE 0 END AS per_lot FROM fx_orders_mt4""")
def _(t):
    per = scalars.ratio(F.col("profit_usd"), F.col("volume"))
    return t.fx_orders_mt4.select("order_id", F.when(F.col("volume") != 0, per).otherwise(0.0).alias("per_lot"))


@query("ratio_filter", """
WITH a AS (
  SELECT user_uid, COUNT(*) AS n, SUM(CASE WHEN profit BETWEEN -0.01 AND 0 THEN 1 ELSE 0 END)::BIGINT AS p0,
         SUM(CASE WHEN spread_revenue_usd < 0.005 THEN 1 ELSE 0 END)::BIGINT AS s0 FROM fx_trades_extra GROUP BY user_uid)
SELECT * FROM a WHERE (p0 > 2 OR s0 > 2) AND p0 / n > 0.1 AND s0 / n > 0.4""")
def _(t):
    agg = t.fx_trades_extra.groupBy("user_uid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("profit").between(-0.01, 0)).alias("p0"), F.count_if(F.col("spread_revenue_usd") < 0.005).alias("s0"))
    return agg.where(((F.col("p0") > 2) | (F.col("s0") > 2)) & (F.col("p0") / F.col("n") > 0.1) & (F.col("s0") / F.col("n") > 0.4))


@query("epoch_zero", """
WITH x AS (SELECT order_id, COALESCE(close_time, TIMESTAMP '1970-01-01') AS close_time FROM fx_trades_extra)
SELECT order_id, close_time FROM x WHERE close_time IS NOT NULL AND close_time != TIMESTAMP '1970-01-01'""")
def _(t):
    closed = F.coalesce("close_time", _ts("1970-01-01"))
    return t.fx_trades_extra.select("order_id", closed.alias("close_time")).where(F.col("close_time").isNotNull() & (F.col("close_time") > _ts("1970-01-01")))


@query("row_index", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS id FROM orders")
def _(t):
    return windows.row_index(t.orders.select("o_orderkey"), "o_orderkey")


@query("select_distinct", "SELECT DISTINCT TIMESTAMP '2023-02-01 00:00:00' AS fact_timest, user_uid FROM fx_trades_extra")
def _(t):
    return t.fx_trades_extra.select(_ts("2023-02-01").alias("fact_timest"), "user_uid").distinct()
