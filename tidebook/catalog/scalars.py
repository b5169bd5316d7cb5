"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook import constants
from tidebook.catalog.registry import as_double, as_long, dbl, query
from tidebook.functions import scalars, text
from tidebook.plans import loans


@query("month_trunc", "SELECT order_id, CAST(date_trunc('month', open_time) AS DATE) AS month FROM fx_orders_mt4")
def _(t):
    return t.fx_orders_mt4.select("order_id", F.trunc("open_time", "month").alias("month"))


@query("day_trunc", "SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS day FROM events")
def _(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"))


@query("minute_trunc", "SELECT date_trunc('minute', ts) AS minute, COUNT(*) AS cnt FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("cnt"))


@query("yyyymm", "SELECT CAST(year(open_time) * 100 + month(open_time) AS INT) AS month_id, COUNT(*) AS cnt FROM fx_trades GROUP BY 1")
def _(t):
    return t.fx_trades.groupBy(scalars.yyyymm(F.col("open_time")).alias("month_id")).agg(F.count(F.lit(1)).alias("cnt"))


@query("epoch_millis", """
SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS request_time, make_timestamp(epoch_us(ts) // 1000 * 1000) - INTERVAL 60 SECOND AS minute_before FROM events""")
def _(t):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    at = scalars.from_epoch_millis(millis)
    return t.events.select(
        "event_id", at.cast("timestamp_ntz").alias("request_time"), (at - F.expr("INTERVAL 60 SECONDS")).cast("timestamp_ntz").alias("minute_before"))


@query("duration_sec", "SELECT order_id, date_diff('second', open_time, close_time) AS seconds FROM fx_trades_extra")
def _(t):
    return t.fx_trades_extra.select("order_id", scalars.seconds_between(F.col("open_time"), F.col("close_time")).alias("seconds"))


@query("days_between", "SELECT id, CAST(date_diff('day', regdt, org_creation_date) AS INT) AS days FROM fx_companies")
def _(t):
    return t.fx_companies.select("id", F.date_diff("org_creation_date", "regdt").alias("days"))


@query("date_parts", """
SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(dayofweek(ts) AS INT) AS w FROM events""")
def _(t):
    return t.events.select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"), (F.dayofweek("ts") - 1).alias("w"))


@query("parse_date", """
SELECT loan_id, date_begin AS parsed, CASE WHEN loan_id % 3 = 0 THEN NULL ELSE date_begin END AS coerced FROM fx_loans""")
def _(t):
    dotted = F.date_format("date_begin", "dd.MM.yyyy")
    broken = F.when(F.col("loan_id") % 3 == 0, F.lit("2016-99-01")).otherwise(F.date_format("date_begin", "yyyy-MM-dd"))
    return t.fx_loans.select("loan_id", F.to_date(dotted, "dd.MM.yyyy").alias("parsed"), F.try_to_date(broken, "yyyy-MM-dd").alias("coerced"))


@query("add_interval", """
SELECT order_id, open_time + INTERVAL 30 DAY AS until, CAST(open_time AS DATE) - 1 AS day_before FROM fx_orders_mt4""")
def _(t):
    return t.fx_orders_mt4.select(
        "order_id", (F.col("open_time") + F.expr("INTERVAL 30 DAYS")).alias("until"), F.date_sub(F.to_date("open_time"), 1).alias("day_before"))


@query("decimal_comma", "SELECT loan_id, CAST(amount AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS bad FROM fx_loans")
def _(t):
    written = F.translate(F.col("amount").cast("string"), ".", ",")
    return t.fx_loans.select("loan_id", scalars.decimal_comma(written).alias("amount"), scalars.decimal_comma(F.lit("n/a")).alias("bad"))


@query("regex_suffix_strip", "SELECT symbol, regexp_replace(symbol, '[empkfzc]$', '') AS symbol_reg, COUNT(*) AS cnt FROM fx_deals_mt5 GROUP BY 1, 2")
def _(t):
    base = scalars.strip_suffix(F.col("symbol"), constants.SPREAD_SUFFIX_LETTERS)
    return t.fx_deals_mt5.groupBy("symbol", base.alias("symbol_reg")).agg(F.count(F.lit(1)).alias("cnt"))


@query("substr_replace", """
SELECT event_id, CAST(TRY_CAST(NULLIF(REPLACE(REPLACE(SUBSTR(props, 7, 3), '}', ''), '"', ''), '') AS FLOAT) AS DOUBLE) AS k FROM events""")
def _(t):
    return t.events.select("event_id", text.number_from_substring(F.col("props"), 7, 3, ("}", '"')).cast("double").alias("k"))


@query("concat_op", "SELECT c_custkey, c_name || '/' || c_custkey || c_mktsegment AS label FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.concat(F.col("c_name"), F.lit("/"), F.col("c_custkey"), F.col("c_mktsegment")).alias("label"))


@query("lower", "SELECT doc_id, lower(text) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.lower("text").alias("text"))


@query("split_pick", """
SELECT DISTINCT NULLIF(split_part(url, '/', 4), '') AS number FROM pages WHERE len(string_split(url, '/')) > 3""")
def _(t):
    part = text.path_segment(F.col("url"), 3)
    return t.pages.select(part.alias("number")).where("number IS NOT NULL").distinct().select(F.nullif("number", F.lit("")).alias("number"))


@query("squeeze_ws", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", text.squeeze_spaces(F.col("text")).alias("text"))


@query("keep_charset", "SELECT conv_id, turn, regexp_replace(text, '[^A-Za-zÀ-ÿ.,]', ' ', 'g') AS text FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", text.keep_letters(F.col("text"), "A-Za-zÀ-ÿ.,").alias("text"))


@query("math", """
SELECT l_orderkey, l_linenumber, ROUND(ABS(l_discount - l_tax), 4) AS gap, CAST(sign(l_discount - l_tax) AS INT) AS side, ROUND(power(0.1::DOUBLE, l_linenumber - 1), 8) AS pip,
  ROUND(sqrt(l_extendedprice), 6) AS root, ROUND(l_quantity * l_quantity, 4) AS square, ROUND(l_quantity * l_tax, 4) AS product FROM lineitem""")
def _(t):
    d = F.col("l_discount") - F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(F.abs(d), 4).alias("gap"), F.signum(d).cast("int").alias("side"),
        F.round(F.pow(F.lit(0.1), F.col("l_linenumber") - 1), 8).alias("pip"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.round(F.col("l_quantity") * F.col("l_quantity"), 4).alias("square"), F.round(F.col("l_quantity") * F.col("l_tax"), 4).alias("product"))


@query("spread_calc", """
SELECT order_id, ROUND((open_symbol_ask - open_symbol_bid) / power(0.1::DOUBLE, digits - 1), 4) AS pips,
  ROUND((open_symbol_ask - open_symbol_bid) * (contract_size * open_xr_quote_currency_to_usd), 2) AS usd FROM fx_orders_mt4""")
def _(t):
    ask, bid = F.col("open_symbol_ask"), F.col("open_symbol_bid")
    return t.fx_orders_mt4.select(
        "order_id", F.round(scalars.spread_pips(ask, bid, F.col("digits")), 4).alias("pips"),
        scalars.spread_usd(ask, bid, F.col("contract_size"), F.col("open_xr_quote_currency_to_usd")).alias("usd"))


@query("annuity_payment", """
SELECT loan_id, CASE WHEN i = 0 THEN ROUND(a / term_months, 2) ELSE ROUND(a * i * power(1 + i, term_months) / (power(1 + i, term_months) - 1), 2) END AS payment
FROM (SELECT loan_id, CAST(amount AS DOUBLE) AS a, interest_rate_effect / 1200 AS i, term_months FROM fx_loans)""")
def _(t):
    return loans.loan_payments(t.fx_loans).select("loan_id", "payment")


@query("linspace_grid", """
SELECT o_orderstatus, CAST(i AS INT) AS i, ROUND(lo + i * ((hi - lo) / 9.0), 6) AS x
FROM (SELECT o_orderstatus, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders GROUP BY 1) CROSS JOIN range(10) r(i)""")
def _(t):
    ends = t.orders.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return ends.select("o_orderstatus", F.posexplode(scalars.linspace(F.col("lo"), F.col("hi"), 10)).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("weighted_vote", """
WITH v AS (SELECT o_orderkey, CAST(o_orderkey % 2 AS INT) AS a, CAST(o_orderkey % 3 > 0 AS INT) AS b, CAST(o_custkey % 2 AS INT) AS c, CAST(o_totalprice > 250000 AS INT) AS d FROM orders)
SELECT o_orderkey, a * b * c * d AS vote, (a + b + c + d) / 4.0 AS mean_vote FROM (SELECT o_orderkey, a, b, c, d FROM v)""")
def _(t):
    votes = [F.col("o_orderkey") % 2, F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 2, F.col("o_totalprice") > 250000]
    named = t.orders.select("o_orderkey", *[v.cast("int").alias(n) for v, n in zip(votes, "abcd")])
    return named.select(
        "o_orderkey", F.expr("a * b * c * d").alias("vote"), F.expr("(a + b + c + d) / 4").alias("mean_vote"))


@query("per_user_ratios", """
WITH u AS (SELECT user_id, SUM(CASE WHEN operation_type = 'deposit' THEN operation_amount_usd ELSE 0 END)::DOUBLE AS dep,
                  SUM(CASE WHEN operation_type = 'withdrawal' THEN operation_amount_usd ELSE 0 END)::DOUBLE AS wd FROM fx_balance GROUP BY 1)
SELECT user_id, CASE WHEN dep != 0 THEN ROUND(wd / dep, 6) WHEN wd > 0 THEN 'inf'::DOUBLE END AS prcnt_withdrawal FROM u""")
def _(t):
    def of(kind):
        return F.sum(F.when(F.col("operation_type") == kind, F.col("operation_amount_usd")).otherwise(0))

    sums = t.fx_balance.groupBy("user_id").agg(of("deposit").alias("dep"), of("withdrawal").alias("wd"))
    share = scalars.float_ratio(F.col("wd"), F.col("dep"))
    return sums.select("user_id", F.when(F.col("dep") != 0, F.round(share, 6)).otherwise(share).alias("prcnt_withdrawal"))


@query("month_end_series", """
WITH b AS (SELECT MIN(date) AS lo, COUNT(DISTINCT year(date) * 100 + month(date)) AS n FROM fx_prices)
SELECT CAST(last_day(lo + CAST(i AS INT) * INTERVAL 1 MONTH) AS DATE) AS month_end FROM b, range(1000) r(i) WHERE i < n""")
def _(t):
    ends = t.fx_prices.agg(F.min("date").alias("lo"), F.count_distinct(scalars.yyyymm(F.col("date"))).alias("n"))
    return ends.select(F.explode(scalars.month_ends(F.col("lo"), F.col("n"))).alias("month_end"))
