"""Sorting, limits and repeatable sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import as_double, dbl, query
from tidebook.operators import sampling
from tidebook.plans import rejects


@query("order_multi", "SELECT o_orderpriority, o_custkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_custkey")
def _(t):
    return t.orders.select("o_orderpriority", "o_custkey", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_custkey")


@query("nulls_last", "SELECT order_id, close_time FROM fx_orders_mt4 ORDER BY close_time DESC NULLS LAST, order_id")
def _(t):
    return t.fx_orders_mt4.select("order_id", "close_time").orderBy(F.desc_nulls_last("close_time"), "order_id")


@query("limit_n", "SELECT event_id, ts, event_type FROM events ORDER BY event_id LIMIT 100")
def _(t):
    return t.events.select("event_id", "ts", "event_type").orderBy("event_id").limit(100)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("sort_values", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey")


@query("shuffle_rows", "SELECT c_custkey, c_acctbal, md5('42|' || c_custkey) AS place FROM customer ORDER BY place")
def _(t):
    rows = t.customer.select("c_custkey", "c_acctbal", sampling.hash_order(42, "c_custkey").alias("place"))
    return sampling.shuffle_rows(rows, 42, "c_custkey")


@query("sample_one_per_group", """
WITH d AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month, date FROM fx_prices)
SELECT month, arg_min(date, md5('7|' || month || '|' || date)) AS date FROM d GROUP BY month""")
def _(t):
    days = t.fx_prices.select(F.trunc("date", "month").alias("month"), "date").distinct()
    return sampling.sample_one_per_group(days, ["month"], ["date"], 7)


@query("sample_papers", "SELECT paper FROM (SELECT DISTINCT paper FROM fx_prices) ORDER BY md5('7|' || paper) LIMIT 12")
def _(t):
    return sampling.sample_k(t.fx_prices.select("paper").distinct(), 12, 7, "paper")


@query("random_amount", """
SELECT month, 2000 + CAST(floor(4000 * (('0x' || substr(md5('5|' || month), 1, 8))::BIGINT / 4294967296.0)) AS BIGINT) AS amount
FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM fx_prices)""")
def _(t):
    months = t.fx_prices.select(F.trunc("date", "month").alias("month")).distinct()
    return months.withColumn("amount", 2000 + F.floor(4000 * sampling.hash_share(5, "month")))


@query("train_test_split", """
SELECT CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS part, lang, COUNT(*) AS cnt FROM documents GROUP BY 1, 2""")
def _(t):
    train, test = sampling.split(t.documents.select("doc_id", "lang"), 0.2, 42, "doc_id")
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test"))).groupBy("part", "lang").agg(F.count(F.lit(1)).alias("cnt"))


@query("nested_split", """
WITH s AS (SELECT doc_id, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS a, ('0x' || substr(md5('43|' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS b FROM documents)
SELECT doc_id, CASE WHEN b < 0.33 THEN 'test' ELSE 'train' END AS part FROM s WHERE a < 0.2""")
def _(t):
    _, held = sampling.split(t.documents.select("doc_id"), 0.2, 42, "doc_id")
    train, test = sampling.split(held, 0.33, 43, "doc_id")
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
