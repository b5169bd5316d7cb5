"""Sources and sinks: what is written to the shared folder is read back and checked."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from tidebook.catalog.registry import as_double, dbl, query
from tidebook.catalog.reports import LOCKER_COLUMNS, LOCKER_CTES, RISK_CTES, _lockers
from tidebook.functions import html
from tidebook.functions.text import squeeze_spaces
from tidebook.plans import portfolio, risk
from tidebook.session import shared_dir
from tidebook.sources import files, quotes, sinks

SQL_DIR = Path(__file__).resolve().parent.parent / "sql"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
ORDER_NAMES = [c.split()[0] for c in ORDERS.split(", ")]


@query("csv_scan", ORDERS_SQL)
def _(t):
    path = shared_dir(t.spark, "orders-csv")
    t.orders.select(*ORDER_NAMES).write.csv(path, sep=";", header=True)
    return files.read_delimited(t.spark, path, ORDERS, sep=";")


@query("csv_cp1251", """
SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ОСНО' WHEN c_mktsegment = 'MACHINERY' THEN 'ЕНВД' ELSE 'УСН доходы' END AS tax_system
FROM customer""")
def _(t):
    tax = F.when(F.col("c_mktsegment") == "BUILDING", "ОСНО").when(F.col("c_mktsegment") == "MACHINERY", "ЕНВД").otherwise("УСН доходы")
    path = shared_dir(t.spark, "companies-cp1251")
    t.customer.select(F.col("c_custkey").alias("id"), tax.alias("tax_system")).write.csv(path, sep="\t", header=True, encoding="windows-1251")
    return files.read_delimited(t.spark, path, "id bigint, tax_system string", sep="\t", encoding="windows-1251")


@query("multi_file_scan", """
SELECT replace(paper, '#', '-') AS paper, date, CAST(close * stock_in_lot AS DOUBLE) AS close FROM fx_prices JOIN fx_lots ON paper = stock""")
def _(t):
    path = shared_dir(t.spark, "price-files")
    rows = t.fx_prices.select("date", F.lit("18:45").alias("time"), "close", F.translate("paper", "#", "-").alias("ticker"))
    rows.write.partitionBy("ticker").csv(path, header=True)
    lots = t.fx_lots.withColumn("stock", F.translate("stock", "#", "-"))
    prices = files.read_price_files(t.spark, path, "date date, time string, close decimal(18,2)", lots, r"ticker=([^/]+)/")
    return as_double(prices.select("paper", "date", "close"), 4)


@query("table_scan", ORDERS_SQL)
def _(t):
    return t.orders.select(*ORDER_NAMES)


@query("sql_file_run", """
SELECT u.country_code, COUNT(DISTINCT u.user_id) AS cnt_users, COUNT(DISTINCT b.user_id) AS cnt_users_with_money,
  ROUND(AVG(CASE WHEN operation_type = 'deposit' THEN operation_amount_usd END), 4) AS avg_deposit
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY registration_time) AS rn FROM fx_users) u
LEFT JOIN fx_balance b ON b.user_id = u.user_id WHERE u.rn = 1 GROUP BY u.country_code""")
def _(t):
    return files.run_sql_file(t.spark, str(SQL_DIR / "country_totals.sql"), {"users": t.fx_users, "balance": t.fx_balance})


@query("sql_params", """
SELECT TIMESTAMP '1998-06-02 00:00:00' AS fact_timest, user_uid, COUNT(*) AS cnt_deals FROM fx_deals_extra
WHERE entry = 1 AND lower(server_name) LIKE '%real%' AND date >= DATE '1998-06-01' AND date < DATE '1998-06-02' GROUP BY user_uid""")
def _(t):
    return files.run_sql_file(t.spark, str(SQL_DIR / "daily_scoring.sql"), {"deals": t.fx_deals_extra}, {"scoring_date": "1998-06-02"})


@query("lookup_dim", """
SELECT paper, date, CAST(close AS DOUBLE) AS close, stock_in_lot FROM fx_prices JOIN fx_lots ON stock = paper""")
def _(t):
    return as_double(t.fx_prices.join(t.fx_lots, F.col("stock") == F.col("paper")).drop("stock"))


@query("inline_relation", """
SELECT symbol, w AS weight, COUNT(*) AS cnt FROM fx_trades JOIN (VALUES ('ECONOMY', 1), ('STANDARD', 2), ('PROMO', 3)) v(s, w) ON s = symbol GROUP BY symbol, w""")
def _(t):
    wanted = t.spark.createDataFrame([("ECONOMY", 1), ("STANDARD", 2), ("PROMO", 3)], "symbol string, weight int")
    return t.fx_trades.join(F.broadcast(wanted), "symbol").groupBy("symbol", "weight").agg(F.count(F.lit(1)).alias("cnt"))


def _quote_pages(t):
    """A stored page per part: a table of names, then one of quotes with an empty price now and then."""
    cell = F.concat(F.lit("<td>"), F.col("p_brand"), F.lit("-"), F.col("p_partkey"), F.lit("</td>"))
    price = F.when(F.col("p_size") > 10, F.col("p_retailprice").cast("string")).otherwise("")
    page = F.concat(
        F.lit("<html><table><tr><th>SECID</th></tr><tr>"), cell, F.lit("</tr></table><table class=\"data\"><tr><th>SECID</th><th>BOARD</th><th>LAST</th></tr>\n<tr>"),
        cell, F.lit("<td>TQBR</td><td><b>"), price, F.lit("</b></td></tr></table></html>"))
    return t.part.select("p_partkey", page.alias("html"))


@query("html_table_scan", """
SELECT p_partkey, p_brand || '-' || p_partkey AS tiker, 'TQBR' AS boardid, CASE WHEN p_size > 10 THEN p_retailprice ELSE 0.0 END AS price FROM part""")
def _(t):
    return quotes.quotes_from_pages(_quote_pages(t), 1, "p_partkey")


def _nested_pages(t):
    """A page per part whose first table has a table in a cell, with rows and cells of its own, left unclosed now and then."""
    page = F.concat(
        F.lit('<HTML><Table class="a"><tr><td>'), F.col("p_brand"), F.lit("<td><table><tr><td>in &amp; "), F.col("p_partkey"), F.lit("</td><td>"), F.col("p_size"),
        F.lit("</td></tr><tr><td>more</td></tr></table> after</td></tr>\n<tr><td>"), F.col("p_type"), F.lit("</td><td></td></tr></TABLE><table><tr><td>last</table>"))
    return t.part.select("p_partkey", page.alias("html"))


@query("html_nested_tables", """
SELECT p_partkey, 0 AS tab, 0 AS pos, p_brand || '|in & ' || p_partkey || ' ' || p_size || ' more after' AS cells FROM part
UNION ALL SELECT p_partkey, 0, 1, p_type || '|' FROM part UNION ALL SELECT p_partkey, 1, 0, 'in & ' || p_partkey || '|' || p_size FROM part
UNION ALL SELECT p_partkey, 1, 1, 'more' FROM part UNION ALL SELECT p_partkey, 2, 0, 'last' FROM part""")
def _(t):
    pages = _nested_pages(t)
    found = [html.table_rows(pages, n, "html", "p_partkey").withColumn("tab", F.lit(n)) for n in range(4)]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return rows.select("p_partkey", "tab", "pos", F.array_join(F.transform("cells", squeeze_spaces), "|").alias("cells"))


@query("append_sink", """
SELECT event_id, value, CAST(ts AS DATE) AS dt FROM events""")
def _(t):
    path = shared_dir(t.spark, "quotes")
    rows = t.events.select("event_id", "value", F.to_date("ts").alias("dt"))
    middle = F.lit("2024-01-15").cast("date")
    early, late = rows.where(F.col("dt") < middle), rows.where(F.coalesce(F.col("dt") >= middle, F.lit(True)))
    sinks.append_load(early, path, "early", ["dt"])
    sinks.write_attempt(late.limit(10), path, "late", ["dt"])  # breaks off before its commit
    for _ in range(2):  # sent, and sent again
        sinks.append_load(late, path, "late", ["dt"])
    return sinks.read_loads(t.spark, path, "event_id bigint, value double, dt date").drop("load")


@query("history_append", """
SELECT run, o_orderstatus, COUNT(*) AS cnt, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders CROSS JOIN (VALUES (1), (2)) r(run) GROUP BY run, o_orderstatus""")
def _(t):
    path = shared_dir(t.spark, "history")
    result = t.orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    for run in (1, 2, 2):  # the second run is retried
        sinks.append_load(result, path, str(run))
    history = sinks.read_loads(t.spark, path, "o_orderstatus string, cnt bigint, total double")
    return history.withColumn("run", F.col("load").cast("int")).drop("load")


@query("csv_sink", "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS id, lang AS label FROM documents")
def _(t):
    from tidebook.operators.windows import row_index

    path = shared_dir(t.spark, "answers")
    sinks.write_csv(row_index(t.documents.select("doc_id", "lang"), "doc_id").select("id", F.col("lang").alias("label")), path)
    return files.read_delimited(t.spark, path, "id bigint, label string")


@query("text_sink", "SELECT lower(role) || ' ' || conv_id || ' ' || turn AS value FROM conversations")
def _(t):
    path = shared_dir(t.spark, "posts")
    line = F.concat_ws(" ", F.lower("role"), "conv_id", "turn").alias("line")
    sinks.write_text(t.conversations.select(line), "line", path)
    return t.spark.read.text(path)


@query("ctas_sink", f"WITH {LOCKER_CTES} SELECT {LOCKER_COLUMNS} FROM features")
def _(t):
    name = f"mirror_locker_{uuid.uuid4().hex[:12]}"
    return as_double(sinks.replace_table(_lockers(t), name, shared_dir(t.spark, name)), 4)


@query("view_layer", f"WITH {RISK_CTES} SELECT user_uid, ROUND(gain, 4) AS profit_coef FROM classed WHERE possibility_error = 'high'")
def _(t):
    name = f"v_mirror_lockers_{uuid.uuid4().hex[:12]}"
    risk.mirror_locker_risk(_lockers(t)).createOrReplaceTempView(name)
    return as_double(t.spark.sql(f"SELECT user_uid, profit_coef FROM {name} WHERE possibility_error = 'high'"), 4)


@query("gated_load", """
SELECT event_id, value AS price, ts AS dt_load FROM events
WHERE hour(ts) BETWEEN 12 AND 21 AND dayofweek(ts) BETWEEN 0 AND 4 AND value IS NOT NULL AND value != 0""")
def _(t):
    rows = t.events.select("event_id", F.col("value").alias("price"), "ts")
    return quotes.session_load(rows, "ts", "price")


IRIS_NAMES = {i: f"species_{i}" for i in range(10)}


# The four named measures of the flower set, then the other parts of the vectors.
MEASURES = ["sepal_length", "sepal_width", "petal_length", "petal_width", *(f"part_{i}" for i in range(4, 64))]


@query("dataset_frame", f"SELECT {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS {n}' for i, n in enumerate(MEASURES))}, 'species_' || label AS target FROM embeddings")
def _(t):
    cells = t.embeddings.select(*[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(len(MEASURES))], "label")
    return files.named_dataset(cells, MEASURES, "target", IRIS_NAMES)
