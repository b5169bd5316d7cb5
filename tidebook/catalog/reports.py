"""End-to-end reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook import constants
from tidebook.catalog.registry import as_double, as_long, dbl, query
from tidebook.operators.aggregates import class_stats, corr_with, histogram
from tidebook.plans import churn, loans, portfolio, rejects, risk, stores, swaps, users, web
from tidebook.session import materialize

TAX = {"osno": "OSNO", "envd": "ENVD", "usn": "USN", "expense": "rashodov"}
FLOWS = [f"{k}_{s}_{m}" for k in ("deposit", "withdrawal") for s in ("ext", "int") for m in ("sum_usd_amt", "cnt")]


@query("hedge_stopout", """
WITH real_deals AS (
  FROM fx_deals_mt5 SELECT *, comment = 'D-NULL' AS reset
  WHERE year(time) BETWEEN 1995 AND 2001 AND contains(lower(server_name), 'real') AND (starts_with(comment, '[so') OR comment = 'D-NULL')
    AND NOT list_contains([46000004, 45002204, 46000006], login)),
legs AS (
  FROM real_deals d
  SELECT d.user_uid, date_trunc('month', d.time)::DATE AS month, d.symbol, if(d.action = 0, 1, if(d.action = 1, -1, NULL)) * d.volume AS amount,
    (SELECT COUNT(*) FROM real_deals r WHERE r.reset AND r.login = d.login AND r.time < d.time) AS resets
  WHERE NOT d.reset AND (d.login IN (12, 25) OR EXISTS (FROM fx_account_dim a WHERE a.code = d.login))),
sides AS (
  FROM legs SELECT month, {'user': user_uid, 'resets': resets} AS stopout, bool_or(amount > 0) AND bool_or(amount < 0) AS hedged
  GROUP BY month, user_uid, resets, symbol)
FROM sides SELECT month AS date, COUNT(DISTINCT stopout) FILTER (hedged) AS cnt_hedge_so, COUNT(DISTINCT stopout) AS cnt_total_so GROUP BY month""")
def _(t):
    return risk.hedge_stopout(t.fx_deals_mt5, t.fx_account_dim, "1995-01-01", "2002-01-01", excluded=constants.PROVIDER_LOGINS, extra=(12, 25))


EXPOSURE_SQL = """
WITH orders_ AS (
  FROM fx_orders_mt4 SELECT user_uid, symbol, open_time, close_time, profit_usd, if(cmd IN (0, 2, 4), 'buy', 'sell') AS way,
    if(cmd IN (0, 2, 4), 1, -1) * volume_opened_usd AS size
  WHERE cmd BETWEEN 0 AND 6 AND open_time >= DATE '1995-01-01'),
deals_ AS (
  FROM fx_deals_mt5 SELECT user_uid, symbol, time, if(entry = action, 'buy', 'sell') AS way, if(entry = 0, volume_usd, -(volume_usd + profit_usd)) AS size
  WHERE entry IN (0, 1) AND action IN (0, 1) AND time >= DATE '1995-01-01'),
held AS (
  FROM orders_ SELECT 'order' AS kind, user_uid, symbol, way, size WHERE open_time < DATE '1997-01-01' AND close_time >= DATE '1997-01-01'
  UNION ALL FROM deals_ SELECT 'deal', user_uid, symbol, way, size WHERE time < DATE '1997-01-01'),
steps AS (
  FROM (FROM orders_ SELECT user_uid, symbol, way,
          unnest([{'at': open_time, 'size': size, 'profit': 0}, {'at': close_time, 'size': -size, 'profit': profit_usd}], recursive := true)
        WHERE open_time >= DATE '1997-01-01') SELECT user_uid, symbol, way, "at", size, profit WHERE "at" IS NOT NULL
  UNION ALL FROM deals_ SELECT user_uid, symbol, way, time, size, 0 WHERE time >= DATE '1997-01-01'
  UNION ALL FROM held SELECT user_uid, symbol, way, TIMESTAMP '1997-01-01' - INTERVAL 1 MINUTE, SUM(size), 0 GROUP BY kind, user_uid, symbol, way),
exact_ AS (
  FROM steps SELECT user_uid, symbol, way, "at", size::DECIMAL(24,4) AS size, profit::DECIMAL(24,4) AS profit),
day_segment AS (
  FROM fx_segments SELECT user_uid, trading_date, MAX(client_value_segment_ccode) AS segment
  WHERE trading_date >= DATE '1995-01-01' AND client_value_segment_ccode BETWEEN '0' AND '5' AND length(client_value_segment_ccode) = 1 GROUP BY ALL)
SELECT e.user_uid, e.symbol, e."at" AS date_deal, e.way AS first_deal_way, e.size::DOUBLE AS volume_usd, e.profit::DOUBLE AS profit, g.segment,
  (SUM(e.size) OVER total)::DOUBLE AS cumsum, (SUM(e.size) OVER side)::DOUBLE AS cumsum_way
FROM exact_ e LEFT JOIN day_segment g ON (g.user_uid, g.trading_date) = (e.user_uid, e."at"::DATE)
WINDOW total AS (PARTITION BY e.user_uid, e.symbol ORDER BY e."at", e.way, e.size, e.profit ROWS UNBOUNDED PRECEDING),
  side AS (PARTITION BY e.user_uid, e.symbol, e.way ORDER BY e."at", e.size, e.profit ROWS UNBOUNDED PRECEDING)"""


@query("exposure_timeline", EXPOSURE_SQL)
def _(t):
    out = risk.exposure_timeline(t.fx_orders_mt4, t.fx_deals_mt5, t.fx_segments, "1995-01-01", "1997-01-01", None)
    return out.withColumns({c: F.col(c).cast("double") for c in ("volume_usd", "profit", "cumsum", "cumsum_way")})


LOCKER_CTES = """
closed AS (
  FROM fx_orders_mt4 SELECT user_uid, volume_closed_usd AS usd, profit_usd AS gain, volume::DECIMAL(18,2) AS lot, volume <= 100 AS small
  WHERE volume_closed_usd IS NOT NULL AND cmd BETWEEN 0 AND 6 AND year(close_time) BETWEEN 1995 AND 1999
  UNION ALL FROM fx_deals_mt5 SELECT user_uid, volume_closed_usd, profit_usd, volume_closed, volume_closed >= 100
  WHERE entry = 1 AND action IN (0, 1) AND year(time) BETWEEN 1995 AND 1999),
features AS (
  FROM (FROM closed SELECT user_uid, ROUND(SUM(usd), 2) AS sum_volume_closed_usd, ROUND(SUM(gain)::DECIMAL(30,4), 2) AS profit_usd,
      SUM(lot) AS sum_volume_closed_lot, MAX(lot) AS max_volume_closed_lot, COUNT(usd) AS cnt_orders_closed,
      COUNT(*) FILTER (small) AS cnt_closed_orders_less_1_lot GROUP BY user_uid)
  LEFT JOIN (FROM fx_balance_daily SELECT user_uid, {flows} WHERE year(fact_date) BETWEEN 1995 AND 1999 GROUP BY user_uid) USING (user_uid))
""".format(flows=", ".join(f"SUM({c}) AS {c}" for c in FLOWS))
LOCKER_COLUMNS = ", ".join(
    ["user_uid", "CAST(sum_volume_closed_usd AS DOUBLE) AS sum_volume_closed_usd", "CAST(profit_usd AS DOUBLE) AS profit_usd",
     "CAST(sum_volume_closed_lot AS DOUBLE) AS sum_volume_closed_lot", "CAST(max_volume_closed_lot AS DOUBLE) AS max_volume_closed_lot",
     "CAST(cnt_orders_closed AS BIGINT) AS cnt_orders_closed", "CAST(cnt_closed_orders_less_1_lot AS BIGINT) AS cnt_closed_orders_less_1_lot"]
    + [f"CAST({c} AS {'BIGINT' if c.endswith('cnt') else 'DOUBLE'}) AS {c}" for c in FLOWS])


def _lockers(t):
    return risk.mirror_locker_features(
        t.fx_orders_mt4, t.fx_deals_mt5, t.fx_balance_daily, "1995-01-01", "2000-01-01", "1995-01-01", "1999-12-31")


@query("mirror_locker_features", f"WITH {LOCKER_CTES} SELECT {LOCKER_COLUMNS} FROM features")
def _(t):
    return as_double(_lockers(t), 4)


RISK_CTES = f"""{LOCKER_CTES},
limits(name, place, lot, above, below, small) AS (VALUES ('high', 1, 31, 0.79, -0.49, 6), ('medium', 2, 11, 0.49, -0.39, 9)),
measured AS (
  FROM features SELECT *, greatest(sum_volume_closed_lot::DOUBLE / nullif(cnt_orders_closed, 0), max_volume_closed_lot::DOUBLE) AS peak,
    coalesce(profit_usd::DOUBLE / nullif(deposit_ext_sum_usd_amt + deposit_int_sum_usd_amt, 0)::DOUBLE, 0) AS gain),
classed AS (
  FROM measured m SELECT *, coalesce((SELECT arg_min(name, place) FROM limits l
    WHERE m.peak >= l.lot AND NOT (m.gain < l.above AND m.gain > l.below) AND m.cnt_closed_orders_less_1_lot <= l.small), 'low') AS possibility_error)
"""


@query("mirror_locker_risk", f"""
WITH {RISK_CTES}
SELECT possibility_error, ROUND(peak, 4) AS past_24_hr_max, ROUND(gain, 4) AS profit_coef, CAST(cnt_closed_orders_less_1_lot AS BIGINT) AS over_1_coef, {LOCKER_COLUMNS}
FROM classed""")
def _(t):
    return as_double(risk.mirror_locker_risk(_lockers(t)), 4)


@query("rounders", """
WITH latest AS (
  FROM fx_deals_extra SELECT entry, login, position_id, if(entry = 1, date, NULL) AS day, if(entry = 1, user_uid, NULL) AS who, if(entry = 0, reason, NULL) AS why,
    max_by(profit, (updated, version)) FILTER (profit IS NOT NULL) AS gain, max_by(spread_revenue_usd, (updated, version)) FILTER (spread_revenue_usd IS NOT NULL) AS revenue,
    max_by(xr_account_currency_to_usd, (updated, version)) FILTER (xr_account_currency_to_usd IS NOT NULL) AS rate
  WHERE action < 2 AND contains(lower(server_name), 'real') AND NOT starts_with(coalesce(comment, ''), 'close hedge by')
    AND date_diff('day', date, DATE '2000-01-01') BETWEEN 1 AND 3000 AND NOT list_contains([46000004, 45002204, 46000006], login)
    AND (entry = 0 OR (entry = 1 AND time_msc IS NOT NULL)) GROUP BY ALL),
trips AS (
  FROM latest c JOIN latest o ON (c.entry, o.entry) = (1, 0) AND (c.login, c.position_id) = (o.login, o.position_id)
  SELECT 5 AS platform, c.who AS user_uid, c.gain, c.revenue::DOUBLE / c.rate AS spread
  UNION ALL FROM fx_trades_extra SELECT 4, user_uid, profit, spread_revenue_usd::DOUBLE / open_xr_account_currency_to_usd
  WHERE cmd < 2 AND contains(lower(server), 'real') AND NOT starts_with(coalesce(comment, ''), 'close hedge by') AND close_time IS NOT NULL
    AND date_diff('day', open_time::DATE, DATE '2000-01-01') BETWEEN 1 AND 3000)
SELECT DISTINCT TIMESTAMP '2000-01-01 00:00:00' AS fact_timest, user_uid FROM trips GROUP BY platform, user_uid
HAVING greatest(count_if(gain BETWEEN -0.01 AND 0), count_if(spread < 0.005)) > 2
  AND count_if(gain BETWEEN -0.01 AND 0) > 0.05 * COUNT(user_uid) AND count_if(spread < 0.005) > 0.4 * COUNT(user_uid)""")
def _(t):
    return risk.rounders(t.fx_deals_extra, t.fx_trades_extra, "2000-01-01", 3000, excluded=constants.PROVIDER_LOGINS, min_count=2, profit_share=0.05, spread_share=0.4)


@query("swap_free_cost", """
WITH flags AS (
  FROM fx_swap_profiles SELECT uid, updated::DATE AS day, muslim
  WHERE updated >= DATE '1996-01-01' AND updated < DATE '1999-01-01'
  QUALIFY row_number() OVER (PARTITION BY uid, updated::DATE ORDER BY updated DESC, seq DESC) = 1),
charges AS (
  FROM fx_charged_swaps c JOIN fx_swap_quotes q
    ON q.dt = c.rollover_mt_time::DATE AND q.side = ['Ask', 'Bid'][c.action + 1]
    AND starts_with(c.symbol, q.symbol) AND list_contains(['', 'm', 'c', 'z', 'r', 'p', 'e'], substr(c.symbol, length(q.symbol) + 1))
  SELECT c.*, abs(q.value)::DOUBLE * c.volume_lots::DOUBLE * c.to_usd::DOUBLE AS would_cost
  WHERE c.rollover_default_value_usd = 0 AND contains(lower(c.server_name), 'real') AND year(c.rollover_mt_time) BETWEEN 1995 AND 1999)
SELECT strftime(c.rollover_mt_time, '%Y%m')::INT AS year_month, c.symbol, f.muslim, ROUND(SUM(c.would_cost), 4) AS swap_charged,
  SUM(c.rollover_default_value_usd)::BIGINT AS default_sum_usd, SUM(c.rollover_actual_value_usd)::DOUBLE AS actual_sum_usd,
  SUM(c.rollover_actual_value_usd - c.rollover_default_value_usd)::DOUBLE AS swap_loss_usd
FROM charges c LEFT JOIN flags f ON f.uid = c.user_uid AND f.day = c.date GROUP BY ALL""")
def _(t):
    return as_double(swaps.swap_free_cost(
        t.fx_charged_swaps, t.fx_swap_quotes, t.fx_swap_profiles, "1995-01-01", "2000-01-01", None, profiles_between=("1996-01-01", "1999-01-01")), 4)


SWAP_SYMBOLS = ("ECONOMYm", "ECONOMYc", "STANDARDm", "PROMO", "SMALLc", "LARGE")


@query("swap_symbol_counts", """
SELECT symbol, COUNT(*) AS cnt FROM fx_charged_swaps
WHERE rollover_mt_time >= TIMESTAMP '1995-01-01' AND rollover_mt_time < TIMESTAMP '2000-01-01'
  AND rollover_default_value_usd = 0 AND lower(server_name) LIKE '%real%'
  AND symbol IN ('ECONOMYm','ECONOMYc','STANDARDm','PROMO','SMALLc','LARGE') GROUP BY symbol""")
def _(t):
    return swaps.swap_symbol_counts(t.fx_charged_swaps, "1995-01-01", "2000-01-01", SWAP_SYMBOLS)


@query("swap_symbol_coverage", """
SELECT DISTINCT symbol FROM fx_swap_quotes WHERE symbol IN (
  SELECT symbol FROM fx_charged_swaps
  WHERE rollover_mt_time >= TIMESTAMP '1995-01-01' AND rollover_mt_time < TIMESTAMP '2000-01-01'
    AND rollover_default_value_usd = 0 AND lower(server_name) LIKE '%real%')""")
def _(t):
    return swaps.swap_symbol_coverage(t.fx_charged_swaps, t.fx_swap_quotes, "1995-01-01", "2000-01-01")


@query("swap_symbols_in_set", """
SELECT DISTINCT symbol FROM fx_charged_swaps
WHERE rollover_mt_time >= TIMESTAMP '1995-01-01' AND rollover_mt_time < TIMESTAMP '2000-01-01'
  AND rollover_default_value_usd = 0 AND lower(server_name) LIKE '%real%'
  AND symbol IN ('ECONOMYm','ECONOMYc','STANDARDm','PROMO','SMALLc','LARGE')""")
def _(t):
    return swaps.swap_symbols_in_set(t.fx_charged_swaps, "1995-01-01", "2000-01-01", SWAP_SYMBOLS)


@query("country_stats", """
WITH home AS (FROM fx_users SELECT user_id, min_by(country_code, (registration_time, country_code)) AS country_code GROUP BY user_id)
FROM home h LEFT JOIN fx_balance b USING (user_id)
SELECT h.country_code, COUNT(DISTINCT h.user_id) AS cnt_users, COUNT(DISTINCT h.user_id) FILTER (b.operation_type IS NOT NULL) AS cnt_users_with_money,
  ROUND(AVG(b.operation_amount_usd) FILTER (b.operation_type = 'deposit'), 4) AS avg_deposit,
  ROUND(AVG(b.operation_amount_usd) FILTER (b.operation_type = 'withdrawal'), 4) AS avg_withdrawal
GROUP BY ALL""")
def _(t):
    return as_double(users.country_stats(t.fx_users, t.fx_balance), 4)


@query("top_trader_profile", """
WITH by_symbol AS (
  FROM fx_trades SELECT user_id, symbol, COUNT(profit_usd) AS deals, count_if(profit_usd > 0) AS won, SUM(profit_usd) AS gain GROUP BY ALL),
by_user AS (
  FROM by_symbol SELECT user_id, SUM(gain) AS gain, SUM(deals)::BIGINT AS deals, SUM(won)::BIGINT AS won, list({'symbol': symbol, 'deals': deals, 'gain': gain} ORDER BY symbol) AS s
  GROUP BY user_id QUALIFY SUM(gain) = MAX(SUM(gain)) OVER ())
FROM by_user b JOIN (FROM fx_users SELECT user_id, country_code, COUNT(*) AS times GROUP BY ALL) u USING (user_id)
SELECT b.user_id, u.country_code AS country, (b.gain * u.times)::DOUBLE AS sum_profit, (b.deals * u.times)::BIGINT AS cnt_deals, (b.won * u.times)::BIGINT AS cnt_profit_deals,
  list_filter(b.s, lambda x: x.deals = list_max([y.deals FOR y IN b.s]))[1].symbol AS symbol_populare,
  list_filter(b.s, lambda x: x.gain = list_max([y.gain FOR y IN b.s]))[1].symbol AS symbol_profit,
  list_filter(b.s, lambda x: x.gain = list_min([y.gain FOR y IN b.s]))[1].symbol AS symbol_loss""")
def _(t):
    return as_double(users.top_trader_profile(t.fx_trades, t.fx_users), 4)


FUNNEL_CTES = """
registered AS (FROM fx_users SELECT user_id, unnest(min_by({'country': country_code, 'registration_time': registration_time}, (registration_time, country_code))) GROUP BY user_id),
traded AS (
  FROM fx_trades SELECT user_id, SUM(profit_usd)::DOUBLE AS total_profit,
    min_by({'profit': profit_usd, 'open': open_time}, (open_time, close_time, order_id, line_no, profit_usd)) AS opening GROUP BY user_id),
paid_in AS (
  FROM fx_balance b JOIN (FROM fx_balance SELECT user_id, MIN(operation_time) AS at_ WHERE operation_type = 'deposit' GROUP BY user_id) f USING (user_id)
  SELECT user_id, f.at_, SUM(b.operation_amount_usd)::DOUBLE AS amount WHERE b.operation_type = 'deposit' AND b.operation_time = f.at_ GROUP BY user_id, f.at_),
early AS (
  FROM (FROM fx_trades SELECT user_id, close_time AS at_, profit_usd AS profit, NULL AS paid, NULL AS taken
        UNION ALL FROM fx_balance SELECT user_id, operation_time, NULL, if(operation_type = 'deposit', operation_amount_usd, 0), if(operation_type = 'withdrawal', operation_amount_usd, 0)) x
  JOIN fx_users u USING (user_id) SELECT user_id, SUM(profit)::DOUBLE AS profit_30_days, SUM(paid)::DOUBLE AS deposit_30_days, SUM(taken)::DOUBLE AS withdrawal_30_days
  WHERE x.at_ - INTERVAL 30 DAY <= u.registration_time GROUP BY user_id),
funnel AS (
  FROM registered LEFT JOIN traded USING (user_id) LEFT JOIN paid_in USING (user_id) LEFT JOIN early USING (user_id)
  SELECT user_id, country, registration_time, opening.profit::DOUBLE AS first_deal_profit, opening.open AS first_deal_open_time, amount AS sum_first_deposit,
    at_ AS dt_first_deposit, profit_30_days, deposit_30_days, withdrawal_30_days, total_profit)
"""


def _funnel(t):
    return as_double(users.user_funnel(t.fx_users, t.fx_trades, t.fx_balance), 4)


@query("user_funnel", f"WITH {FUNNEL_CTES} SELECT * FROM funnel")
def _(t):
    return _funnel(t)


METRICS = ["prcnt_profit", "prcnt_withdrawal", "deposit_30_days", "profit_30_days"]


@query("funnel_outliers", f"""
WITH {FUNNEL_CTES},
data AS (
  SELECT *, CASE WHEN deposit_30_days != 0 THEN profit_30_days / deposit_30_days
                 WHEN deposit_30_days = 0 AND profit_30_days > 0 THEN CAST('inf' AS DOUBLE)
                 WHEN deposit_30_days = 0 AND profit_30_days < 0 THEN CAST('-inf' AS DOUBLE) END AS prcnt_profit,
    CASE WHEN deposit_30_days != 0 THEN withdrawal_30_days / deposit_30_days
         WHEN deposit_30_days = 0 AND withdrawal_30_days > 0 THEN CAST('inf' AS DOUBLE) END AS prcnt_withdrawal
  FROM funnel),
ranked AS (
  SELECT m, v, row_number() OVER (PARTITION BY m ORDER BY v) - 1 AS pos, COUNT(*) OVER (PARTITION BY m) AS n
  FROM (UNPIVOT data ON {', '.join(METRICS)} INTO NAME m VALUE v) WHERE v IS NOT NULL),
ends AS (
  SELECT m, MAX(CASE WHEN pos = floor(0.975 * (n - 1)) THEN v END) AS a, MAX(CASE WHEN pos = ceil(0.975 * (n - 1)) THEN v END) AS b,
         MAX(0.975 * (n - 1) - floor(0.975 * (n - 1))) AS part FROM ranked GROUP BY m),
edges AS (SELECT m, CASE WHEN a = b THEN a ELSE a + part * (b - a) END AS edge FROM ends),
bad AS ({' UNION '.join(f"SELECT user_id FROM data WHERE {m} > (SELECT edge FROM edges WHERE m = '{m}')" for m in METRICS)})
SELECT user_id, country, ROUND(profit_30_days, 4) AS profit_30_days, ROUND(deposit_30_days, 4) AS deposit_30_days,
  ROUND(withdrawal_30_days, 4) AS withdrawal_30_days FROM data WHERE user_id NOT IN (SELECT user_id FROM bad)""")
def _(t):
    data = materialize(users.funnel_ratios(_funnel(t)), "funnel")
    return users.drop_outlier_users(data, METRICS).select("user_id", "country", "profit_30_days", "deposit_30_days", "withdrawal_30_days")


SPREAD_CTES = """
ticks AS (
  FROM fx_deals_mt5 SELECT symbol, contract_size, digits, entry = 0 AS counts, symbol_ask AS ask, symbol_bid AS bid, xr_quote_currency_to_usd AS rate, volume_usd AS money
  WHERE action IN (0, 1) AND entry IN (0, 1, 3) AND year(time) BETWEEN 1995 AND 1999
  UNION ALL BY NAME FROM fx_orders_mt4 SELECT symbol, contract_size, digits, true AS counts, open_symbol_ask AS ask, open_symbol_bid AS bid,
    open_xr_quote_currency_to_usd AS rate, volume_opened_usd + volume_closed_usd AS money
  WHERE cmd IN (0, 1) AND year(open_time) BETWEEN 1995 AND 1999),
raw AS (
  FROM ticks SELECT if(contains('empkfzc', right(symbol, 1)), left(symbol, -1), symbol) AS symbol_reg, contract_size, money::DECIMAL(20,2) AS volume_usd,
    if(counts, (ask - bid) / power(0.1::DOUBLE, digits - 1), NULL) AS spread_pips, if(counts, ROUND((ask - bid) * (contract_size * rate), 2), NULL) AS spread_usd
  WHERE ask <> bid)
"""


@query("spread_by_instrument", f"""
WITH {SPREAD_CTES}
SELECT symbol_reg, CASE WHEN contract_size = 1000 AND symbol_reg != 'USOIL' THEN 'cent' ELSE 'standart' END AS type_account, contract_size,
  CAST(SUM(volume_usd) AS DOUBLE) AS tv_sum, ROUND(AVG(spread_pips), 4) AS avg_spread_pip, ROUND(AVG(spread_usd), 4) AS avg_spread_usd,
  ROUND(quantile_cont(spread_pips, 0.80), 4) AS spread_pip_80_perc, ROUND(quantile_cont(spread_pips, 0.95), 4) AS spread_pip_95_perc,
  ROUND(quantile_cont(spread_usd, 0.80), 4) AS spread_usd_80_perc, ROUND(quantile_cont(spread_usd, 0.95), 4) AS spread_usd_95_perc
FROM raw GROUP BY 1, 2, 3""")
def _(t):
    return as_double(risk.spread_by_instrument(t.fx_deals_mt5, t.fx_orders_mt4, "1995-01-01", "2000-01-01", None, exact=True), 4)


@query("reject_leaders", """
SELECT uuid, COUNT(1) AS cnt FROM fx_responses WHERE comment = 'margin no money (precheck)' GROUP BY uuid""")
def _(t):
    return rejects.reject_leaders(t.fx_responses)


@query("user_trades", """
WITH chosen AS (
  SELECT uuid FROM fx_responses WHERE comment = 'margin no money (precheck)' GROUP BY uuid ORDER BY COUNT(1) DESC, uuid LIMIT 2)
SELECT user_uid, account_currency, symbol, volume, cmd, CAST(open_price AS DOUBLE) AS open_price, open_time AS deal_time,
  CAST(open_time AS DATE) AS dt, CAST(close_price AS DOUBLE) AS close_price, CAST(close_price - open_price AS DOUBLE) AS price_change,
  CAST(profit AS DOUBLE) AS profit, open_time, close_time, date_diff('second', open_time, close_time) AS duration_sec,
  close_xr_account_currency_to_usd, CAST(spread_revenue_usd AS DOUBLE) AS spread_revenue_usd, open_xr_account_currency_to_usd
FROM fx_trades_extra
WHERE cmd IN (0,1) AND open_time >= TIMESTAMP '1995-01-01' AND user_uid IN (SELECT CAST(uuid AS BIGINT) FROM chosen)""")
def _(t):
    chosen = rejects.top_rejected(t.fx_responses, 2).select("uuid")
    return as_double(rejects.user_trades(t.fx_trades_extra, chosen, "1995-01-01"), 4).orderBy("user_uid", "open_time")


@query("top_rejected_profit", """
WITH leaders AS (
  SELECT uuid, COUNT(1) AS cnt, row_number() OVER (ORDER BY COUNT(1) DESC, uuid) AS rn FROM fx_responses
  WHERE comment = 'margin no money (precheck)' GROUP BY uuid)
SELECT user_uid, CAST(rn AS INT) AS rn, CAST(SUM(profit) AS DOUBLE) AS profit
FROM fx_trades_extra JOIN leaders w ON user_uid = CAST(w.uuid AS BIGINT) AND w.rn < 20
WHERE cmd IN (0,1) AND open_time >= TIMESTAMP '1995-01-01' GROUP BY user_uid, rn""")
def _(t):
    return as_double(rejects.top_rejected_profit(t.fx_trades_extra, t.fx_responses, "1995-01-01"), 4)


@query("response_breakdown", """
SELECT response_result, comment, COUNT(*) AS cnt FROM fx_responses WHERE response_result IN (1, 2) GROUP BY 1, 2""")
def _(t):
    return rejects.response_breakdown(t.fx_responses, (1, 2))


@query("reject_streaks", """
WITH base AS (
  SELECT *, lag(comment) OVER (PARTITION BY uuid, login ORDER BY request_ts, event_id) AS prev FROM fx_responses),
s AS (
  SELECT uuid, login, SUM(CASE WHEN comment = prev AND comment = 'margin no money (precheck)' THEN 1 ELSE 0 END)
    OVER (PARTITION BY uuid, login ORDER BY request_ts) AS incidents FROM base)
SELECT uuid, login, CAST(MAX(incidents) AS BIGINT) AS max_incidents FROM s GROUP BY uuid, login HAVING max_incidents > 2""")
def _(t):
    return rejects.reject_streaks(t.fx_responses, 2)


@query("reject_share", """
SELECT login, CAST(SUM(CASE WHEN response_result = 2 THEN 1 ELSE 0 END) AS BIGINT) AS cnt_reset_req, CAST(SUM(1) AS BIGINT) AS cnt_req,
  ROUND(CAST(SUM(CASE WHEN response_result = 2 THEN 1 ELSE 0 END) AS DOUBLE) / SUM(1), 6) AS part_reset_req
FROM fx_responses WHERE uuid != '' GROUP BY login HAVING cnt_reset_req > 10""")
def _(t):
    return as_double(rejects.reject_share(t.fx_responses))


@query("reject_minutes", """
WITH logins AS (
  SELECT date_trunc('hour', request_ts) AS scoring_time, login, SUM(CASE WHEN response_result = 2 THEN 1 ELSE 0 END) AS n
  FROM fx_responses WHERE response_result IN (1,2,3) AND uuid != '' GROUP BY 1, 2 HAVING n > 1)
SELECT scoring_time, COUNT(login) AS cnt_logins FROM logins GROUP BY scoring_time""")
def _(t):
    return rejects.reject_minutes(t.fx_responses, "hour")


@query("toxicity_counts", """
SELECT CAST(TRY_CAST(NULLIF(REPLACE(REPLACE(REPLACE(SUBSTR(props, 7, 3), ',', ''), '"', ''), '}', ''), '') AS FLOAT) AS DOUBLE) AS toxicity,
  COUNT(*) AS cnt_deal FROM fx_responses GROUP BY 1""")
def _(t):
    return as_double(rejects.toxicity_counts(t.fx_responses, "props", 7, 3, (",", '"', "}")))


@query("loan_issuance", """
WITH m AS (SELECT month(date_begin) AS month, SUM(amount) AS amount FROM fx_loans GROUP BY 1),
d AS (SELECT date_begin, SUM(amount) AS amount FROM fx_loans GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series(MIN(date_begin), MAX(date_begin), INTERVAL 1 DAY)) AS DATE) AS day FROM fx_loans)
SELECT 'month' AS grain, CAST(g.month AS VARCHAR) AS period, CAST(COALESCE(amount, 0) AS DOUBLE) AS amount
FROM (SELECT unnest(generate_series(1, 12)) AS month) g LEFT JOIN m ON m.month = g.month
UNION ALL SELECT 'day', CAST(day AS VARCHAR), CAST(COALESCE(amount, 0) AS DOUBLE) FROM days LEFT JOIN d ON d.date_begin = days.day""")
def _(t):
    return as_double(loans.loan_issuance(t.fx_loans), 4)


@query("churn_features", """
WITH r AS (SELECT * FROM fx_companies WHERE regdt IS NOT NULL),
m AS (SELECT MAX(org_creation_date) AS top FROM r),
c AS (
  SELECT id, tax_system, CASE WHEN org_creation_date < DATE '2000-01-01' THEN top ELSE org_creation_date END AS org, regdt, top, is_prolong,
    CASE WHEN tax_system LIKE '%ENVD%' AND tax_system LIKE '%USN%' THEN 'usn_envd' WHEN tax_system LIKE '%rashodov%' THEN 'usn_rashod'
         WHEN tax_system = 'ENVD' THEN 'envd' WHEN tax_system = 'OSNO' THEN 'osno' ELSE 'usn_dohod' END AS tax_class
  FROM r CROSS JOIN m)
SELECT id, tax_class, CASE WHEN org < regdt THEN regdt ELSE org END AS org_creation_date,
  CAST(date_diff('day', org, top) AS INT) AS age_days,
  CAST(CASE WHEN date_diff('day', regdt, top) >= 5000 THEN 5000 ELSE date_diff('day', regdt, top) END AS INT) AS reg_age_days,
  CASE WHEN org < regdt THEN 1 ELSE 0 END AS is_misdated,
  CAST(month(CASE WHEN org < regdt THEN regdt ELSE org END) AS INT) AS month, CAST(month(regdt) AS INT) AS reg_month,
  CASE WHEN date_diff('day', org, top) < 60 THEN 1 ELSE 0 END AS is_recent,
  CASE WHEN tax_class = 'osno' THEN 1 ELSE 0 END AS osno, CASE WHEN tax_class = 'envd' THEN 1 ELSE 0 END AS envd,
  CASE WHEN tax_class = 'usn_envd' THEN 1 ELSE 0 END AS usn_envd, CASE WHEN tax_class = 'usn_rashod' THEN 1 ELSE 0 END AS usn_rashod,
  CASE WHEN tax_class = 'usn_dohod' THEN 1 ELSE 0 END AS usn_dohod, is_prolong FROM c""")
def _(t):
    return churn.churn_features(t.fx_companies, TAX).select(
        "id", "tax_class", "org_creation_date", "age_days", "reg_age_days", "is_misdated", "month", "reg_month", "is_recent",
        *churn.TAX_CLASSES, "is_prolong")


BREAKDOWN_DIMS = ("tax_class", "has_certificate", "documents_count", "worker_count", "month", "reg_month", "is_misdated")


@query("churn_breakdown", f"""
WITH r AS (SELECT * FROM fx_companies WHERE regdt IS NOT NULL),
m AS (SELECT MAX(org_creation_date) AS top FROM r),
c AS (
  SELECT *, CASE WHEN org_creation_date < DATE '2000-01-01' THEN top ELSE org_creation_date END AS org FROM r CROSS JOIN m),
f AS (
  SELECT is_prolong, has_certificate, documents_count, worker_count, month(greatest(org, regdt)) AS month, month(regdt) AS reg_month,
    CASE WHEN org < regdt THEN 1 ELSE 0 END AS is_misdated, date_diff('day', org, top) < 60 AS recent,
    CASE WHEN tax_system LIKE '%ENVD%' AND tax_system LIKE '%USN%' THEN 'usn_envd' WHEN tax_system LIKE '%rashodov%' THEN 'usn_rashod'
         WHEN tax_system = 'ENVD' THEN 'envd' WHEN tax_system = 'OSNO' THEN 'osno' ELSE 'usn_dohod' END AS tax_class FROM c)
{' UNION ALL '.join(
    f"SELECT '{scope}' AS scope, '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, is_prolong, COUNT(*) AS cnt FROM f {where} GROUP BY 3, 4"
    for d in BREAKDOWN_DIMS for scope, where in (('all', ''), ('recent', 'WHERE recent')))}""")
def _(t):
    return churn.churn_breakdown(churn.churn_features(t.fx_companies, TAX), BREAKDOWN_DIMS)


@query("churn_age_histogram", """
WITH r AS (SELECT * FROM fx_companies WHERE regdt IS NOT NULL),
m AS (SELECT MAX(org_creation_date) AS top FROM r),
a AS (
  SELECT is_prolong, CAST(date_diff('day', CASE WHEN org_creation_date < DATE '2000-01-01' THEN top ELSE org_creation_date END, top) AS DOUBLE) AS v
  FROM r CROSS JOIN m),
b AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM a)
SELECT is_prolong, CAST(LEAST(floor((v - lo) / ((hi - lo) / 40.0)), 39) AS INT) AS bin, COUNT(*) AS cnt FROM a CROSS JOIN b GROUP BY 1, 2""")
def _(t):
    return histogram(churn.churn_features(t.fx_companies, TAX), "age_days", 40, ["is_prolong"])


@query("dividend_per_lot", """
SELECT tiker, date, CAST(dividend AS DOUBLE) AS dividend, stock_in_lot, CAST(dividend * stock_in_lot AS DOUBLE) AS div_by_lot,
  CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year, CAST(year(date) * 100 + month(date) AS INT) AS month_id
FROM fx_dividends JOIN fx_lots ON tiker = stock""")
def _(t):
    return as_double(portfolio.dividend_per_lot(t.fx_dividends, t.fx_lots))


PLAN_CTES = """
caps AS (SELECT paper AS stock, ROUND(AVG(CAST(close AS DOUBLE)), 2) AS max_buy_price FROM fx_prices GROUP BY paper),
lotp AS (
  SELECT paper, date, CAST(year(date) * 100 + month(date) AS INT) AS month_id, close * stock_in_lot AS price, stock_in_lot
  FROM fx_prices JOIN fx_lots ON paper = stock),
days AS (SELECT DISTINCT date, month_id FROM lotp),
picked AS (
  SELECT month_id, date FROM (
    SELECT *, row_number() OVER (PARTITION BY month_id ORDER BY date) - 1 AS pos, COUNT(*) OVER (PARTITION BY month_id) AS n FROM days)
  WHERE pos = CAST(month_id AS BIGINT) * 7919 % n),
elig AS (
  SELECT l.month_id, l.date, l.paper, l.price FROM lotp l JOIN picked p ON p.month_id = l.month_id AND p.date = l.date
  JOIN caps ON caps.stock = l.paper WHERE l.price < max_buy_price * stock_in_lot),
plan AS (SELECT month_id, date, paper, price, 1.0 / COUNT(*) OVER (PARTITION BY month_id) AS share FROM elig),
held AS (
  SELECT s.month_id, s.paper, SUM(1) AS held
  FROM (SELECT DISTINCT m.month_id, p.paper FROM (SELECT DISTINCT month_id FROM plan) m JOIN plan p ON p.month_id <= m.month_id) s
  JOIN plan p ON p.paper = s.paper AND p.month_id <= s.month_id GROUP BY 1, 2)
"""
BALANCE_CTES = """
val AS (
  SELECT h.month_id, SUM(h.held * l.price) AS value FROM held h JOIN picked d ON d.month_id = h.month_id
  JOIN lotp l ON l.month_id = h.month_id AND l.date = d.date AND l.paper = h.paper GROUP BY 1),
spent AS (SELECT month_id, date, SUM(price) AS spent, row_number() OVER (ORDER BY month_id) AS k FROM plan GROUP BY month_id, date),
bal AS (
  SELECT s.month_id, s.date, 300000.0 + 2000.0 * k AS invested,
    300000.0 + 2000.0 * k - 150 * k - CAST(SUM(spent) OVER (ORDER BY s.month_id) AS DOUBLE) * 1.001 AS cash,
    COALESCE(CAST(value AS DOUBLE), 0) AS value FROM spent s LEFT JOIN val ON val.month_id = s.month_id)
"""


def _caps(t):
    return t.fx_prices.groupBy(F.col("paper").alias("stock")).agg(F.round(F.avg(F.col("close").cast("double")), 2).alias("max_buy_price"))


def _plan(t):
    return portfolio.monthly_plan(t.fx_prices, t.fx_lots, _caps(t))


def _ledger(t):
    return portfolio.buy_ledger(_plan(t))


@query("monthly_plan", f"WITH {PLAN_CTES} SELECT month_id, date, paper, CAST(price AS DOUBLE) AS price, ROUND(CAST(share AS DOUBLE), 6) AS share FROM plan")
def _(t):
    return as_double(_plan(t))


@query("holdings_value", f"""
WITH {PLAN_CTES}, {BALANCE_CTES}
SELECT month_id, date, ROUND(CAST(invested AS DOUBLE), 3) AS invested, ROUND(CAST(cash AS DOUBLE), 3) AS cash, ROUND(CAST(value AS DOUBLE), 3) AS value,
  ROUND(CAST(cash + value AS DOUBLE), 3) AS balance FROM bal""")
def _(t):
    ledger = materialize(_ledger(t), "ledger")
    return as_double(portfolio.holdings_value(ledger, t.fx_prices, t.fx_lots), 3)


@query("dividend_cash", f"""
WITH {PLAN_CTES},
d AS (
  SELECT CAST(year(date) * 100 + month(date) AS INT) AS month_id, tiker AS paper, dividend * stock_in_lot AS lot
  FROM fx_dividends JOIN fx_lots ON tiker = stock),
c AS (SELECT h.month_id, h.paper, h.held * d.lot AS gross FROM held h JOIN d ON d.month_id = h.month_id AND d.paper = h.paper WHERE d.lot > 0)
SELECT 'year' AS grain, CAST(month_id // 100 AS VARCHAR) AS key, ROUND(CAST(SUM(gross) AS DOUBLE) * 0.87, 4) AS cash FROM c GROUP BY 2
UNION ALL SELECT 'month', CAST(month_id AS VARCHAR), ROUND(CAST(SUM(gross) AS DOUBLE) * 0.87, 4) FROM c GROUP BY 2
UNION ALL SELECT 'paper', paper, ROUND(CAST(SUM(gross) AS DOUBLE) * 0.87, 4) FROM c GROUP BY 2
UNION ALL SELECT 'total', 'all', ROUND(CAST(SUM(gross) AS DOUBLE) * 0.87, 4) FROM c HAVING COUNT(*) > 0""")
def _(t):
    ledger = materialize(_ledger(t), "ledger")
    return as_double(portfolio.dividend_cash(ledger, t.fx_dividends, t.fx_lots), 4)


@query("final_score", f"""
WITH {PLAN_CTES}, {BALANCE_CTES}
SELECT month_id, ROUND(CAST(invested AS DOUBLE), 3) AS invested, ROUND(CAST(cash + value AS DOUBLE), 3) AS balance,
  ROUND(CAST((cash + value) / invested AS DOUBLE), 6) AS score FROM bal ORDER BY month_id DESC LIMIT 1""")
def _(t):
    ledger = materialize(_ledger(t), "ledger")
    out = portfolio.final_score(ledger, t.fx_prices, t.fx_lots)
    return out.withColumns({"invested": dbl("invested", 3), "balance": dbl("balance", 3), "score": dbl("score", 6)})


IRIS = [f"x{i}" for i in range(64)]


def iris(t):
    return t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(IRIS)], "label")


IRIS_SQL = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(len(IRIS))) + ", label FROM embeddings"


@query("class_stats", f"""
WITH iris AS ({IRIS_SQL}),
long AS (SELECT CAST(label AS VARCHAR) AS class, variable, value FROM (UNPIVOT iris ON {', '.join(IRIS)} INTO NAME variable VALUE value)),
both_ AS (SELECT * FROM long UNION ALL SELECT 'all', variable, value FROM long),
s AS (SELECT class, variable, AVG(value) AS mean, MEDIAN(value) AS median, STDDEV_SAMP(value) AS std FROM both_ GROUP BY 1, 2)
SELECT class, variable, statistic, ROUND(value, 6) AS value FROM (UNPIVOT s ON mean, median, std INTO NAME statistic VALUE value)""")
def _(t):
    return as_double(class_stats(iris(t), IRIS, "label"))


@query("store_cleaning", """
WITH p AS (
  SELECT CAST(CASE WHEN l_orderkey = 17 THEN NULL ELSE l_quantity END AS DOUBLE) AS q0, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS t0,
         l_discount, l_extendedprice, l_linenumber FROM lineitem),
f AS (
  SELECT COALESCE(q0, (SELECT AVG(q0) FROM p)) AS quantity, COALESCE(t0, (SELECT AVG(t0) FROM p)) AS tax, l_discount AS discount,
         l_extendedprice AS price, CAST(l_linenumber AS DOUBLE) AS line FROM p),
z AS (SELECT * FROM f WHERE ABS((price - (SELECT AVG(price) FROM f)) / (SELECT STDDEV_SAMP(price) FROM f)) < 3)
SELECT feature, ROUND(corr, 6) AS corr FROM (
  UNPIVOT (SELECT corr(quantity, price) AS quantity, corr(tax, price) AS tax, corr(discount, price) AS discount, corr(line, price) AS line FROM z)
  ON quantity, tax, discount, line INTO NAME feature VALUE corr)""")
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", F.col("l_quantity").alias("quantity"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"),
        F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").cast("double").alias("line"))
    cleaned = stores.clean_stores(rows, {}, ["quantity", "tax"], ("l_orderkey", 17, "quantity"), "price")
    return as_double(stores.target_correlations(cleaned, ["quantity", "tax", "discount", "line"], "price"))


# Nested replacements of the character references that the stored pages have, and of inline tags.
def decoded_sql(text: str) -> str:
    tags = f"regexp_replace(regexp_replace({text}, '</?(a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|u)(\\s[^>]*)?>', '', 'gi'), '<[^>]+>', ' ', 'g')"
    return f"replace(replace(replace(replace(replace(replace({tags}, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


LINKS_SQL = f"""
WITH a AS (
  SELECT page_id, unnest(list_zip(range(len(x)), x)) AS z FROM (
    SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=.*?</a>') AS x FROM pages)),
links AS (
  SELECT page_id, CAST(z[1] AS INT) AS pos, replace(regexp_extract(z[2], 'href="([^"]*)"', 1), '&amp;', '&') AS href, trim({decoded_sql("z[2]")}) AS text FROM a)
"""


@query("link_extract", LINKS_SQL + "SELECT page_id, pos, href, text FROM links")
def _(t):
    return web.bank_links(t.pages)


@query("link_numbers", LINKS_SQL + """
SELECT DISTINCT split_part(href, '/', 2) AS number FROM links WHERE len(string_split(href, '/')) > 1""")
def _(t):
    return web.path_numbers(web.bank_links(t.pages), 1)


@query("article_extract", f"""
WITH x AS (
  SELECT page_id, url AS link, regexp_extract(html, '(?s)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?s)<article(?:\\s[^>]*)?>(.*?)</article>', 1) AS b FROM pages),
y AS (
  SELECT page_id, link, NULLIF(trim(regexp_replace({decoded_sql("h")}, '\\s+', ' ', 'g')), '') AS title,
         NULLIF(trim(regexp_replace({decoded_sql("b")}, '\\s+', ' ', 'g')), '') AS body FROM x)
SELECT * FROM y WHERE title IS NOT NULL AND body IS NOT NULL""")
def _(t):
    return web.articles(t.pages)


POST_LETTERS, POST_DROP = "a-zà-ÿ.,", ("http", "@", "rt ")


@query("post_cleaning", """
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-zà-ÿ.,]', ' ', 'g'), '\\s+', ' ', 'g')) AS text
FROM conversations WHERE NOT contains(lower(text), 'http') AND NOT contains(lower(text), '@') AND NOT contains(lower(text), 'rt ')""")
def _(t):
    return web.clean_posts(t.conversations, "text", POST_LETTERS, POST_DROP).select("conv_id", "turn", "text")
