"""The warehouse tables the jobs read, projected from the parquet star schema.

Each projection is plain SQL that Spark and DuckDB both run. ``{orders}`` and the like
stand for the physical tables: a DataFrame in Spark, the view of that name in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

PROJECTIONS = {
    "fx_users": """
SELECT c_custkey AS user_id, n_name AS country_code,
       DATE '1995-01-01' + CAST(c_custkey % 2000 AS INT) AS registration_time
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT c_custkey, n_name, DATE '1995-01-01' + CAST(c_custkey % 2000 + 400 AS INT)
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0""",
    "fx_balance": """
SELECT o_orderkey AS op_id, o_custkey AS user_id,
       CASE o_orderstatus WHEN 'F' THEN 'deposit' WHEN 'O' THEN 'withdrawal' ELSE 'transfer' END AS operation_type,
       o_orderdate AS operation_time, CAST(o_totalprice AS DECIMAL(18,2)) AS operation_amount_usd
FROM {orders}""",
    "fx_trades": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS user_id, p_type AS symbol,
       CAST(l_extendedprice * (l_discount - l_tax) AS DECIMAL(18,4)) AS profit_usd,
       o_orderdate AS open_time, o_orderdate + l_linenumber * INTERVAL '5' DAY AS close_time
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "fx_deals_mt5": """
SELECT l_orderkey AS position_id, l_linenumber AS line_no, o_custkey AS user_uid,
       o_custkey * 10 + l_suppkey % 3 AS login, l_shipdate AS time,
       CASE l_returnflag WHEN 'A' THEN 'D-NULL' WHEN 'R' THEN '[so 50%]' ELSE NULL END AS comment,
       CONCAT(p_type, CASE l_linenumber % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'c' ELSE '' END) AS symbol,
       CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS action, l_linenumber % 2 AS entry,
       CAST(l_quantity AS DECIMAL(18,2)) AS volume, CAST(l_quantity AS DECIMAL(18,2)) AS volume_closed,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS volume_usd, CAST(l_extendedprice AS DECIMAL(18,2)) AS volume_closed_usd,
       CAST(l_extendedprice * (l_discount - l_tax) AS DECIMAL(18,4)) AS profit_usd,
       CASE WHEN l_suppkey % 4 = 0 THEN 'MT5-Demo' ELSE 'MT5-Real' END AS server_name,
       1.0 + l_tax AS symbol_ask, 1.0 + l_tax - l_discount AS symbol_bid,
       p_size % 5 + 1 AS digits, CASE WHEN p_size % 2 = 0 THEN 1000 ELSE 100000 END AS contract_size,
       1.0 + l_tax AS xr_quote_currency_to_usd, l_orderkey % 3 AS reason
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "fx_orders_mt4": """
SELECT o_orderkey AS order_id, o_custkey AS user_uid, CAST(o_orderkey % 7 AS INT) AS cmd,
       CONCAT('SYM', CAST(o_orderkey % 12 AS VARCHAR(10))) AS symbol, o_orderdate AS open_time,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + (o_orderkey % 40) * INTERVAL '1' DAY END AS close_time,
       CAST(o_orderkey % 300 AS INT) AS volume, CAST(o_totalprice AS DECIMAL(18,2)) AS volume_opened_usd,
       CAST(o_totalprice AS DECIMAL(18,2)) AS volume_closed_usd,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(o_orderkey % 5 - 2 AS INT) AS DECIMAL(18,2)) AS profit_usd,
       CAST(100 + o_orderkey % 9 AS DOUBLE) / 100 AS open_symbol_ask, CAST(1 AS DOUBLE) AS open_symbol_bid,
       CAST(o_orderkey % 5 + 1 AS INT) AS digits, CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 100000 END AS contract_size,
       CAST(10 + o_orderkey % 3 AS DOUBLE) / 10 AS open_xr_quote_currency_to_usd,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Demo1' ELSE 'Real-3' END AS server
FROM {orders}""",
    "fx_deals_extra": """
SELECT CAST(o_orderdate AS DATE) AS date, o_custkey AS user_uid, o_custkey * 10 AS login, o_orderkey AS position_id,
       version, o_orderdate + version * INTERVAL '1' HOUR AS updated, leg AS entry, o_orderkey % 2 AS action,
       CASE WHEN o_orderkey % 13 = 0 AND version = 2 THEN NULL
            ELSE CAST((o_orderkey % 41 - 20 + version) / 1000.0 AS DECIMAL(18,4)) END AS profit,
       CAST((o_orderkey % 7) / 1000.0 AS DECIMAL(18,4)) AS spread_revenue_usd,
       CAST(1.0 + (o_orderkey % 2) AS DOUBLE) AS xr_account_currency_to_usd,
       o_orderdate + (leg * (o_orderkey % 90)) * INTERVAL '1' MINUTE AS time_msc,
       CASE WHEN o_orderkey % 11 = 0 THEN 'close hedge by #1' WHEN o_orderkey % 5 = 0 THEN 'note' ELSE NULL END AS comment,
       CASE WHEN o_orderkey % 10 = 0 THEN 'Demo' ELSE 'MT5-Real2' END AS server_name, o_orderkey % 3 AS reason
FROM {orders} {legs}""",
    "fx_trades_extra": """
SELECT o_orderkey AS order_id, o_custkey AS user_uid, o_orderkey % 3 AS reason, CAST(o_orderkey % 3 AS INT) AS cmd,
       CONCAT('SYM', CAST(o_orderkey % 12 AS VARCHAR(10))) AS symbol, o_orderdate AS open_time,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + (o_orderkey % 40) * INTERVAL '1' HOUR END AS close_time,
       CAST((o_orderkey % 41 - 20) / 1000.0 AS DECIMAL(18,4)) AS profit,
       CAST((o_orderkey % 7) / 1000.0 AS DECIMAL(18,4)) AS spread_revenue_usd,
       CAST(1.0 + (o_orderkey % 2) AS DOUBLE) AS open_xr_account_currency_to_usd,
       CAST(1.0 + (o_orderkey % 2) AS DOUBLE) AS close_xr_account_currency_to_usd,
       CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS account_currency, CAST(o_orderkey % 300 AS INT) AS volume,
       CAST(o_totalprice AS DECIMAL(18,2)) AS open_price, CAST(o_totalprice + o_orderkey % 9 AS DECIMAL(18,2)) AS close_price,
       CASE WHEN o_orderkey % 11 = 0 THEN 'close hedge by #1' ELSE NULL END AS comment,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Demo1' ELSE 'Real-3' END AS server
FROM {orders}""",
    "fx_account_dim": "SELECT c_custkey * 10 AS code FROM {customer} WHERE c_acctbal > 0",
    "fx_segments": """
SELECT o_custkey AS user_uid, CAST(o_orderdate AS DATE) AS trading_date,
       CAST(o_orderkey % 8 AS VARCHAR(4)) AS client_value_segment_ccode
FROM {orders}""",
    "fx_balance_daily": """
SELECT o_custkey AS user_uid, CAST(o_orderdate AS DATE) AS fact_date,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS deposit_ext_sum_usd_amt,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS deposit_ext_cnt,
       CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS deposit_int_sum_usd_amt,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS deposit_int_cnt,
       CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS withdrawal_ext_sum_usd_amt,
       CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS withdrawal_ext_cnt,
       CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS withdrawal_int_sum_usd_amt,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS withdrawal_int_cnt
FROM {orders}""",
    "fx_responses": """
SELECT event_id, CAST(user_id AS VARCHAR(20)) AS uuid, user_id * 10 + event_id % 2 AS login,
       CASE event_type WHEN 'error' THEN 'margin no money (precheck)' WHEN 'view' THEN '' ELSE event_type END AS comment,
       CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 3 ELSE 0 END AS response_result,
       ts AS request_ts, CAST(ts AS DATE) AS date, value, props
FROM {events}""",
    "fx_swap_quotes": """
SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS dt, side,
       CAST(-(MIN(p_size) + CASE side WHEN 'Ask' THEN 1 ELSE 0 END) AS DECIMAL(18,4)) AS value
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey {sides}
GROUP BY p_type, CAST(l_shipdate AS DATE), side""",
    "fx_charged_swaps": """
SELECT l_orderkey AS ticket, l_linenumber AS line_no, o_custkey AS user_uid,
       CONCAT(p_type, CASE l_linenumber % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'c' ELSE '' END) AS symbol,
       CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS action, l_shipdate AS rollover_mt_time,
       CAST(l_shipdate AS DATE) AS date,
       CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS rollover_default_value_usd,
       CAST(l_tax * 100 AS DECIMAL(18,4)) AS rollover_actual_value_usd,
       CAST(l_quantity AS DECIMAL(18,2)) AS volume_lots, CAST(1 AS DECIMAL(9,2)) AS to_usd,
       CASE WHEN l_suppkey % 4 = 0 THEN 'demo' ELSE 'REAL-1' END AS server_name
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "fx_swap_profiles": """
SELECT o_custkey AS uid, o_orderkey AS seq, o_orderdate AS updated,
       CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS muslim, o_orderstatus AS status
FROM {orders}""",
    "fx_prices": """
SELECT p_brand AS paper, CAST(l_shipdate AS DATE) AS date,
       CAST(MAX(l_extendedprice) AS DECIMAL(18,2)) AS close
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)""",
    "fx_lots": "SELECT p_brand AS stock, CAST(MAX(p_size) AS INT) AS stock_in_lot FROM {part} GROUP BY p_brand",
    "fx_dividends": """
SELECT p_brand AS tiker, CAST(o_orderdate AS DATE) AS date, CAST(MIN(l_tax) AS DECIMAL(9,4)) AS dividend
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
WHERE l_returnflag = 'A' GROUP BY p_brand, CAST(o_orderdate AS DATE)""",
    "fx_loans": """
SELECT o_orderkey AS loan_id, CAST(o_orderdate AS DATE) AS date_begin,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(5.0 + o_orderkey % 10 AS DOUBLE) AS interest_rate_effect,
       CAST(6 + o_orderkey % 55 AS INT) AS term_months
FROM {orders}""",
    "fx_companies": """
SELECT c_custkey AS id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'OSNO' WHEN 'MACHINERY' THEN 'ENVD'
            WHEN 'FURNITURE' THEN 'USN ENVD' WHEN 'HOUSEHOLD' THEN 'USN rashodov' ELSE 'USN' END AS tax_system,
       CASE WHEN c_custkey % 9 = 0 THEN DATE '1900-01-01' ELSE DATE '2014-01-01' + CAST(c_custkey % 900 AS INT) END AS org_creation_date,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE DATE '2000-01-01' + CAST(c_custkey * 7 % 5600 AS INT) END AS regdt,
       c_nationkey AS worker_count, CAST(c_custkey % 5 AS INT) AS fss_count, CAST(c_custkey % 6 AS INT) AS pfr_count,
       CAST(c_custkey % 7 AS INT) AS fns_count, CAST(FLOOR((c_acctbal + 1000) / 1000) AS INT) AS documents_count,
       CAST(c_custkey % 3 AS INT) AS cnt_users, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS has_certificate,
       CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS is_prolong
FROM {customer}""",
}

# Constant expansions, written as one narrow step in each dialect (no cross join in Spark).
SPARK_EXPANSIONS = {
    "legs": "LATERAL VIEW explode(array(0, 1)) l AS leg LATERAL VIEW explode(array(1, 2)) v AS version",
    "sides": "LATERAL VIEW explode(array('Ask', 'Bid')) s AS side",
}
DUCKDB_EXPANSIONS = {
    "legs": "CROSS JOIN (VALUES (0), (1)) l(leg) CROSS JOIN (VALUES (1), (2)) v(version)",
    "sides": "CROSS JOIN (VALUES ('Ask'), ('Bid')) s(side)",
}


class Tables:
    """Lazy access to physical tables (``t.orders``) and projections (``t.fx_users``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_SCHEMAS:
            return self.spark.read.schema(BASE_SCHEMAS[name]).parquet(self.path(name))
        if name not in PROJECTIONS:
            raise AttributeError(name)
        text = PROJECTIONS[name]
        for key, value in SPARK_EXPANSIONS.items():
            text = text.replace("{" + key + "}", value)
        bases = {b: getattr(self, b) for b in re.findall(r"\{(\w+)\}", text)}
        return self.spark.sql(text, **bases)


def oracle_text(sql: str) -> str:
    """Prefix ``sql`` with the projections it names, as DuckDB common table expressions."""
    used = [n for n in PROJECTIONS if re.search(rf"\b{n}\b", sql)]
    names = {b: b for b in BASE_SCHEMAS}
    ctes = [f"{n} AS ({PROJECTIONS[n].format(**names, **DUCKDB_EXPANSIONS)})" for n in used]
    body = sql.strip()
    if not ctes:
        return body
    head = "WITH " + ",\n".join(ctes)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head[5:]},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"
