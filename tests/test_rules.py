"""Small cases for the rules that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidebook.functions import html, scalars, text
from tidebook.operators import aggregates, clean, joins, sampling
from tidebook.plans import churn, loans, portfolio, rejects, risk, swaps, users, web
from tidebook.sources import quotes


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_newest_skips_null_versions(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, None), (3, 1, 7.0), (3, 1, 8.0)], "k int, at int, v double")
    got = {r.k: r.v for r in df.groupBy("k").agg(aggregates.newest("v", "at").alias("v")).where("k < 3").collect()}
    assert got == {1: 5.0, 2: None}


def test_masked_assign_last_one_wins(spark):
    df = spark.createDataFrame([("ENVD",), ("USN ENVD",), ("USN rashodov",), ("ENVD USN rashodov",), ("OSNO",), ("patent",)], "tax string")
    labels = {"osno": "OSNO", "envd": "ENVD", "usn": "USN", "expense": "rashodov"}
    got = [r[0] for r in df.select(churn.tax_class(F.col("tax"), labels)).collect()]
    assert got == ["envd", "usn_envd", "usn_rashod", "usn_envd", "osno", "usn_dohod"]


def test_tax_class_with_the_fixed_labels(spark):
    df = spark.createDataFrame([("ОСНО",), ("УСН доходы минус расходов",), ("УСН+ЕНВД",)], "tax string")
    assert [r[0] for r in df.select(churn.tax_class(F.col("tax"))).collect()] == ["osno", "usn_rashod", "usn_envd"]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (4999,), (5000,), (9000,)], "d int")
    assert [r[0] for r in df.select(clean.clip_upper(F.col("d"), 5000)).collect()] == [None, 4999, 5000, 5000]


def test_float_ratio_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (1.0, None)], "n double, d double")
    got = [r[0] for r in df.select(scalars.float_ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [math.inf, -math.inf, None, 0.25, None]


def test_minmax_and_standardize_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    assert [tuple(r) for r in clean.minmax(df, ["a", "c"]).orderBy("a").collect()] == [(0.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in clean.standardize(df, ["a", "c"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_fill_mean_and_zscore(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)] + [(98, None), (99, 1000.0)], "id int, v double")
    filled = clean.fill_mean(df, ["v"])
    assert filled.where("id = 98").first().v == pytest.approx((30 + 1000) / 31)
    kept = clean.zscore_filter(filled, "v")
    assert kept.where("id = 99").count() == 0 and kept.count() == 31


def test_factorize_by_first_appearance(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "id int, c string")
    got = {r.id: r.code for r in clean.factorize(df, "c", "id", "code").collect()}
    assert got == {0: 0, 1: -1, 2: 1, 3: 0}


def test_annuity(spark):
    df = spark.createDataFrame([(1000.0, 12.0, 12), (1200.0, 0.0, 12)], "a double, r double, n int")
    got = [r[0] for r in df.select(scalars.annuity_payment(F.col("a"), F.col("r"), F.col("n"))).collect()]
    assert got == [88.85, 100.0]


def test_days_without_loans_are_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 5), (dt.date(2024, 1, 4), 7), (dt.date(2024, 1, 1), 1)], "date_begin date, amount int")
    assert [r.amount for r in loans.issued_by_day(df).orderBy("day").collect()] == [6, 0, 0, 7]
    assert loans.issued_by_month(df).count() == 12


def test_empty_toxicity_is_null(spark):
    df = spark.createDataFrame([('{"k": 1.5,x',), ('{"k": "",xx',), ('{"k": zzz,x',)], "p string")
    got = [r[0] for r in df.select(text.number_from_substring(F.col("p"), 7, 4, (",", '"', "x"))).collect()]
    assert got == [1.5, None, None]


def test_reject_jobs_on_one_day(spark):
    rows = [("u", 1, "margin no money (precheck)", 2, ts(1, h), h, dt.date(2024, 1, 1)) for h in range(5)]
    rows += [("u", 1, "ok", 1, ts(2), 9, dt.date(2024, 1, 2)), ("", 2, "margin no money (precheck)", 2, ts(2), 10, dt.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "uuid string, login long, comment string, response_result int, request_ts timestamp_ntz, event_id long, date date")
    assert [tuple(r) for r in rejects.reject_streaks(df, 3).collect()] == [("u", 1, 4)]
    assert rejects.reject_streaks(df, 3, day="2024-01-02").count() == 0
    assert [tuple(r) for r in rejects.reject_leaders(df, day="2024-01-01").collect()] == [("u", 5)]
    assert [r.login for r in rejects.reject_share(df, 0).collect()] == [1]


def test_users_without_operations(spark):
    u = spark.createDataFrame([(1, "A", dt.date(2024, 1, 1)), (1, "B", dt.date(2024, 2, 1)), (2, "A", dt.date(2024, 1, 1))], "user_id long, country_code string, registration_time date")
    b = spark.createDataFrame([(1, 1, "deposit", ts(1), 10), (2, 1, "withdrawal", ts(2), 4), (3, 1, "deposit", ts(3), 20)],
                              "op_id long, user_id long, operation_type string, operation_time timestamp_ntz, operation_amount_usd int")
    assert [tuple(r) for r in users.country_stats(u, b).collect()] == [("A", 2, 1, 15.0, 4.0)]


def test_funnel_counts_once_per_registration(spark):
    u = spark.createDataFrame([(1, "A", dt.date(2024, 1, 1)), (1, "A", dt.date(2024, 1, 20)), (2, "B", dt.date(2024, 1, 1))], "user_id long, country_code string, registration_time date")
    tr = spark.createDataFrame([(1, 1, 1, ts(5), ts(6), 10), (2, 1, 1, ts(4), dt.datetime(2024, 2, 10), 7), (3, 1, 1, ts(5), dt.datetime(2025, 1, 1), 100)],
                               "order_id long, line_no int, user_id long, open_time timestamp_ntz, close_time timestamp_ntz, profit_usd int")
    b = spark.createDataFrame([(1, 1, "deposit", ts(3), 5), (2, 1, "deposit", ts(3), 6), (3, 1, "deposit", ts(9), 9)],
                              "op_id long, user_id long, operation_type string, operation_time timestamp_ntz, operation_amount_usd int")
    one, two = users.user_funnel(u, tr, b).orderBy("user_id").collect()
    assert (one.first_deal_profit, one.sum_first_deposit, one.total_profit) == (7, 11, 117)
    assert (one.profit_30_days, one.deposit_30_days, one.withdrawal_30_days) == (10 * 2 + 7, 40, 0)
    assert two.total_profit is None and two.country == "B"


def test_outlier_users_and_the_rest_are_everyone(tables):
    data = users.funnel_ratios(users.user_funnel(tables.fx_users, tables.fx_trades, tables.fx_balance)).cache()
    metrics = ["prcnt_profit", "prcnt_withdrawal", "deposit_30_days", "profit_30_days"]
    kept = users.drop_outlier_users(data, metrics)
    dropped = data.join(kept, "user_id", "left_anti")
    assert 0 < dropped.count() < data.count() and kept.count() + dropped.count() == data.count()


def test_top_trader_keeps_ties(spark):
    tr = spark.createDataFrame([(1, "x", 5), (2, "y", 5), (3, "x", 1), (1, "z", 0)], "user_id long, symbol string, profit_usd int")
    u = spark.createDataFrame([(1, "A"), (2, "B")], "user_id long, country_code string")
    got = {r.user_id: r for r in users.top_trader_profile(tr, u).collect()}
    assert set(got) == {1, 2} and (got[1].symbol_populare, got[1].symbol_profit, got[1].symbol_loss) == ("x", "x", "z")


def test_final_exposure_is_the_signed_sum(tables):
    out = risk.exposure_timeline(tables.fx_orders_mt4, tables.fx_deals_mt5, tables.fx_segments, "1995-01-01", "1997-01-01", None).cache()
    last = out.groupBy("user_uid", "symbol").agg(F.max_by("cumsum", F.struct("date_deal", "first_deal_way", "volume_usd", "profit")).alias("a"), F.sum("volume_usd").alias("b"))
    assert last.where("a != b").count() == 0 and out.count() > 0


def test_risk_class_without_deposits(spark):
    cols = ["deposit_ext_sum_usd_amt", "deposit_int_sum_usd_amt"]
    df = spark.createDataFrame([(1, 10, 400.0, 2, 100.0, 0, None, None), (2, 10, 400.0, 2, 100.0, 0, 50.0, 0.0)],
                               f"user_uid int, profit_usd int, sum_volume_closed_lot double, cnt_orders_closed int, max_volume_closed_lot double, cnt_closed_orders_less_1_lot int, {cols[0]} double, {cols[1]} double")
    got = {r.user_uid: (r.past_24_hr_max, r.profit_coef, r.possibility_error) for r in risk.mirror_locker_risk(df).collect()}
    assert got == {1: (200.0, 0.0, "low"), 2: (200.0, 0.2, "low")}


def test_swap_suffixes(spark):
    q = spark.createDataFrame([("EURUSD",)], "symbol string")
    got = {r.s for r in joins.expand_suffixes(q, "symbol", ("m", ""), "s").collect()}
    assert got == {"EURUSDm", "EURUSD"}


def test_holdings_carry_forward(spark):
    ledger = spark.createDataFrame([(202401, "A"), (202403, "A"), (202402, "B")], "month_id int, paper string").withColumns({"lots": F.lit(1), "price": F.lit(1.0)})
    got = {(r.month_id, r.paper): r.held for r in portfolio.holdings_by_month(ledger).collect()}
    assert got == {(202401, "A"): 1, (202402, "A"): 1, (202403, "A"): 2, (202402, "B"): 1, (202403, "B"): 1}


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    a = sampling.sample_one_per_group(df.repartition(3), ["g"], ["id"], 1).collect()
    b = sampling.sample_one_per_group(df.repartition(9, "id"), ["g"], ["id"], 1).collect()
    assert sorted(a) == sorted(b) and len(a) == 7
    train, test = sampling.split(df, 0.3, 5, "id")
    assert train.count() + test.count() == 1000 and 240 < test.count() < 360 and train.join(test, "id").count() == 0
    assert [r.id for r in sampling.sample_k(df, 12, 3, "id").collect()] == [r.id for r in sampling.sample_k(df.repartition(11), 12, 3, "id").collect()]


def test_cyrillic_posts(spark):
    df = spark.createDataFrame([("Ураган,  ВЕТЕР! 5 м/с.",), ("rt дождь",), ("смотри http://a",), ("@имя",)], "t string")
    got = [r.t for r in web.clean_posts(df, "t", "А-Яа-я.,", ("восход", "rt", "@", "http")).collect()]
    assert got == ["ураган, ветер м с."]


def test_tokens_of_any_script(spark):
    df = spark.createDataFrame([("Ещё один_2 x тест, élan!",)], "t string")
    assert df.select(text.tokens(F.col("t"))).first()[0] == ["ещё", "один_2", "тест", "élan"]


def test_quote_tables(spark):
    page = "<table><tr><td>no</td></tr></table><table><tr><th>a</th></tr><tr><td>SBER</td><td>TQBR</td><td>250.5</td></tr><tr><td>X</td><td>TQBR</td><td></td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, "<p>no table</p>")], "id int, html string")
    got = [tuple(r) for r in quotes.quotes_from_pages(df, 1, "id").collect()]
    assert got == [(1, "SBER", "TQBR", 250.5), (1, "X", "TQBR", 0.0)]


def test_session_gate(spark):
    rows = [(1, 5.0, dt.datetime(2024, 1, 7, 12)), (2, 5.0, dt.datetime(2024, 1, 5, 12)), (3, 0.0, dt.datetime(2024, 1, 8, 13)),
            (4, 5.0, dt.datetime(2024, 1, 8, 22)), (5, 5.0, dt.datetime(2024, 1, 8, 21)), (6, None, dt.datetime(2024, 1, 8, 21))]
    df = spark.createDataFrame(rows, "id int, price double, at timestamp_ntz")
    # The 7th is a Sunday (day 0), the 5th a Friday (day 5).
    assert sorted(r.id for r in quotes.session_load(df, "at", "price").collect()) == [1, 5]


def test_links_and_fields(spark):
    page = '<h1 class="t">Big <b>news</b></h1><section><a href="/doc/1">one</a> <a class="x" href="/rubric/2">two</a></section>'
    df = spark.createDataFrame([(1, "http://s.ru/a", page)], "page_id int, url string, html string")
    found = html.links(df, "html", "page_id", "url")
    assert [(r.pos, r.href, r.text) for r in found.collect()] == [(0, "/doc/1", "one"), (1, "/rubric/2", "two")]
    assert [r.link for r in web.absolute_links(found, web.site_of(F.col("url"))).collect()] == ["http://s.ru/doc/1"]
    assert df.select(html.plain(html.inner(F.col("html"), "h1"))).first()[0] == "Big news"
    assert df.select(html.inner(F.col("html"), "article")).first()[0] is None


def test_path_segments(spark):
    df = spark.createDataFrame([("/a/b/c/2272/",), ("/short",), ("/a/b/c/2272/x",), ("/a/b/c/10/",)], "href string")
    assert [r.number for r in web.path_numbers(df, 4).collect()] == ["10", "2272"]


def test_in_keys_with_constants(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "login long")
    keys = spark.createDataFrame([(1,), (None,)], "code long")
    assert sorted(r.login for r in joins.in_keys(df, "login", keys, (3,)).collect()) == [1, 3]


def test_swap_cost_on_two_quotes(spark):
    charged = spark.createDataFrame(
        [(1, "EURUSDm", 0, ts(3), dt.date(2024, 1, 3), 0, 2, 3, 1, "REAL-1"), (1, "EURUSDm", 1, ts(3), dt.date(2024, 1, 3), 0, 2, 3, 1, "demo")],
        "user_uid long, symbol string, action int, rollover_mt_time timestamp_ntz, date date, rollover_default_value_usd int, rollover_actual_value_usd int, volume_lots int, to_usd int, server_name string")
    quotes_ = spark.createDataFrame([("EURUSD", dt.date(2024, 1, 3), "Ask", -4), ("EURUSD", dt.date(2024, 1, 4), "Ask", -9)], "symbol string, dt date, side string, value int")
    profiles = spark.createDataFrame([(1, 1, ts(3), 1, "a"), (1, 2, ts(3, 5), None, "b")], "uid long, seq long, updated timestamp_ntz, muslim int, status string")
    got = swaps.swap_free_cost(charged, quotes_, profiles, "2024-01-01", "2025-01-01", None).collect()
    assert [(r.year_month, r.symbol, r.muslim, r.swap_charged, r.swap_loss_usd) for r in got] == [(202401, "EURUSDm", 1, 12.0, 2)]


def test_spread_sketch_and_exact_have_the_same_rows(tables):
    def report(exact):
        out = risk.spread_by_instrument(tables.fx_deals_mt5, tables.fx_orders_mt4, "1995-01-01", "2000-01-01", None, exact=exact)
        return {(r.symbol_reg, r.type_account, r.contract_size): r for r in out.collect()}

    sketch, exact = report(False), report(True)
    assert sketch.keys() == exact.keys() and len(exact) > 5
    for key, row in exact.items():
        other = sketch[key].asDict()
        assert set(other) == set(row.asDict()) and other["tv_sum"] == row.tv_sum and other["avg_spread_usd"] == row.avg_spread_usd


def test_nested_elements(spark):
    cases = {
        "<article>a<article>b</article>c</article>d<article>e</article>": ["a<article>b</article>c", "b", "e", None],
        "x<ARTICLE\nid='1'>a</Article >": ["a", None, None, None],
        "<article>open<article>x</article> rest": ["open<article>x", "x", None, None],
        "<article>never closed": [None] * 4,
        "<articles>no</articles>": [None] * 4,
        "<article></article><article>2</article>": [None, "2", None, None],
        "": [None] * 4,
        None: [None] * 4,
        "<article>" * 60 + "deep" + "</article>" * 60: ["<article>" * 59 + "deep" + "</article>" * 59] + ["<article>" * n + "deep" + "</article>" * n for n in (58, 57, 56)],
    }
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "id int, page string")
    got = df.select("id", *[html.inner(F.col("page"), "article", n).alias(f"n{n}") for n in range(4)]).orderBy("id").collect()
    assert [list(r)[1:] for r in got] == list(cases.values())


def test_nested_and_careless_tables(spark):
    page = """<table id=1><thead><tr><th>h</th></tr></thead><tbody><tr><td>a &lt; b</td><td><table><tr><td>in</td></tr></table>out</td></tr>
      <TR><TD class="x">c<td>d</tr> junk <tr></tr></tbody></table><p>text</p><table><tr><td></td></tr></table>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "<table>"), (4, "no table")], "id int, html string")

    def found(n):
        return [(r.id, r.pos, list(r.cells)) for r in html.table_rows(df, n, "html", "id").collect()]

    rows = [(i, pos, [" ".join(c.split()) for c in cells]) for i, pos, cells in found(0)]
    assert rows == [(1, 1, ["a < b", "in out"]), (1, 2, ["c", "d"])]
    assert found(1) == [(1, 0, ["in"])] and found(2) == [(1, 0, [""])] and found(3) == []


def test_a_field_is_computed_once(spark, tables):
    rows = web.articles(tables.pages)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # One cut of the page per field, and one for the depth-counting fold.
    assert plan.count("/?article[") == 1 and plan.count("/?h1[") == 1
