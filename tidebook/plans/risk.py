"""Risk jobs over trading deals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook import constants
from tidebook.functions import scalars
from tidebook.operators import joins, windows
from tidebook.operators.aggregates import newest, unpivot
from tidebook.operators.percentiles import exact_percentiles
from tidebook.session import materialize


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _window(column: str, start: str, end: str) -> Column:
    """Half-open range on the raw column, so it reaches the file scan."""
    return (F.col(column) >= _ts(start)) & (F.col(column) < _ts(end))


def stopout_groups(deals: DataFrame, accounts: DataFrame, start: str, end: str, *, excluded: Sequence[int], extra: Sequence[int]) -> DataFrame:
    """Stop-out deals of real accounts, numbered by the balance resets before them.

    ``excluded`` are accounts of liquidity providers, ``extra`` business accounts that count beside ``accounts``.
    """
    reset = F.col("comment").like(constants.STOPOUT_MARK)
    rows = deals.where(
        _window("time", start, end)
        & (F.startswith("comment", F.lit(constants.STOPOUT_PREFIX)) | reset)
        & F.lower("server_name").like("%real%")
        & ~F.col("login").isin(*excluded)
    )
    rows = joins.in_keys(rows, "login", accounts, extra).select(
        "user_uid", "login", "time", F.trunc("time", "month").alias("date"), "comment", "symbol",
        scalars.signed_volume(F.col("action"), F.col("volume")).alias("volume_dif"),
        reset.cast("int").alias("is_reset"),
    )
    return windows.conditional_event_counter(
        materialize(rows, "stopouts"), ["login"], ["time", "is_reset"], F.col("is_reset") == 1, "stopout_group"
    )


def hedge_stopout(deals: DataFrame, accounts: DataFrame, start: str, end: str, **filters) -> DataFrame:
    """Per month: stop-out groups holding opposite positions in one symbol, and all groups."""
    grouped = (
        stopout_groups(deals, accounts, start, end, **filters)
        .where("is_reset = 0")
        .groupBy("user_uid", "date", "stopout_group", "symbol")
        .agg(F.sum(F.abs("volume_dif")).alias("sum_abs"), F.abs(F.sum("volume_dif")).alias("abs_sum"))
    )
    group_id = F.concat_ws("-", "user_uid", "stopout_group")
    return grouped.groupBy("date").agg(
        F.count_distinct(F.when(F.col("sum_abs") != F.col("abs_sum"), group_id)).alias("cnt_hedge_so"),
        F.count_distinct(group_id).alias("cnt_total_so"),
    ).orderBy("date")


def exposure_moves(orders: DataFrame, deals: DataFrame, start: str, cut: str, symbols: Sequence[str] | None) -> DataFrame:
    """Open positions at ``cut`` (one row per user, symbol and side) and every later move."""
    orders = orders.where((F.col("open_time") >= _ts(start)) & F.col("cmd").isin(0, 1, 2, 3, 4, 5, 6))
    deals = deals.where((F.col("time") >= _ts(start)) & F.col("action").isin(0, 1) & F.col("entry").isin(0, 1))
    if symbols:
        orders, deals = orders.where(F.col("symbol").isin(*symbols)), deals.where(F.col("symbol").isin(*symbols))

    is_buy = F.col("cmd").isin(0, 2, 4)
    order_way = F.when(is_buy, F.lit("buy")).otherwise(F.lit("sell"))
    order_volume = F.when(is_buy, F.col("volume_opened_usd")).otherwise(-F.col("volume_opened_usd"))
    deal_way = scalars.deal_direction(F.col("entry"), F.col("action"))
    deal_volume = F.when(F.col("entry") == 0, F.col("volume_usd")).otherwise(-F.col("volume_usd") - F.col("profit_usd"))
    money, nothing = "decimal(24,4)", F.lit(0).cast("decimal(24,4)")

    before = (_ts(cut) - F.expr("INTERVAL 1 MINUTE")).alias("date_deal")
    opened = orders.where((F.col("open_time") < _ts(cut)) & (F.col("close_time") >= _ts(cut))).select(
        "user_uid", "symbol", order_way.alias("first_deal_way"), order_volume.alias("v"))
    dealt = deals.where(F.col("time") < _ts(cut)).select(
        "user_uid", "symbol", deal_way.alias("first_deal_way"), deal_volume.alias("v"))

    def position(rows: DataFrame) -> DataFrame:
        total = rows.groupBy("user_uid", "symbol", "first_deal_way").agg(F.sum("v").cast(money).alias("volume_usd"))
        return total.select("user_uid", before, "symbol", "first_deal_way", "volume_usd", nothing.alias("profit"))

    # One scan gives both the opening and the closing move of an order.
    opening = F.struct(F.col("open_time").alias("at"), order_volume.cast(money).alias("v"), nothing.alias("p"))
    closing = F.struct(F.col("close_time").alias("at"), (-order_volume).cast(money).alias("v"), F.col("profit_usd").cast(money).alias("p"))
    later_orders = orders.where(F.col("open_time") >= _ts(cut)).select(
        "user_uid", "symbol", order_way.alias("first_deal_way"),
        F.explode(F.when(F.col("close_time").isNotNull(), F.array(opening, closing)).otherwise(F.array(opening))).alias("m"),
    ).select("user_uid", F.col("m.at").alias("date_deal"), "symbol", "first_deal_way", F.col("m.v").alias("volume_usd"), F.col("m.p").alias("profit"))
    later_deals = deals.where(F.col("time") >= _ts(cut)).select(
        "user_uid", F.col("time").alias("date_deal"), "symbol", deal_way.alias("first_deal_way"),
        deal_volume.cast(money).alias("volume_usd"), nothing.alias("profit"))
    return position(opened).union(position(dealt)).union(later_orders).union(later_deals)


def daily_segments(segments: DataFrame, since: str, codes: Sequence[str] = ("0", "1", "2", "3", "4", "5")) -> DataFrame:
    """One segment per user and day, which makes the join key unique."""
    kept = segments.where((F.col("trading_date") >= F.lit(since).cast("date")) & F.col("client_value_segment_ccode").isin(*codes))
    return kept.groupBy("user_uid", "trading_date").agg(F.max("client_value_segment_ccode").alias("segment"))


def exposure_timeline(orders: DataFrame, deals: DataFrame, segments: DataFrame, start: str, cut: str,
                      symbols: Sequence[str] | None = constants.EXPOSURE_SYMBOLS) -> DataFrame:
    """Running exposure per user and symbol, in total and by side, with the user's segment of the day."""
    moves = exposure_moves(orders, deals, start, cut, symbols)
    seg = daily_segments(segments, start).select(F.col("user_uid").alias("seg_user"), "trading_date", "segment")
    same_day = (F.col("seg_user") == F.col("user_uid")) & (F.col("trading_date") == F.to_date("date_deal"))
    # Segments come first, as the rows are narrower without the sums; read for the ranges, their totals and the sums.
    moves = materialize(moves.join(seg, same_day, "left").select(*moves.columns, "segment"), "moves")
    order = ["date_deal", "first_deal_way", "volume_usd", "profit"]
    running = windows.running_sums(
        moves,
        {"cumsum": (["user_uid", "symbol"], F.col("volume_usd")),
         "cumsum_way": (["user_uid", "symbol", "first_deal_way"], F.col("volume_usd"))},
        order,
    )
    return running.select(*[c for c in running.columns if c != "segment"], "segment")


def mirror_locker_features(orders: DataFrame, deals: DataFrame, balance: DataFrame, trade_start: str, trade_end: str,
                           balance_start: str, balance_end: str) -> DataFrame:
    """Closed-trade totals per user beside deposits and withdrawals.

    Both trade sources go through one aggregation. The small-order counter uses opposite
    comparisons in the two sources; that is the rule as given.
    """
    def part(df: DataFrame, volume: str, small: Column) -> DataFrame:
        return df.select("user_uid", "volume_closed_usd", "profit_usd", F.col(volume).cast("decimal(18,2)").alias("lot"), small.cast("int").alias("small"))

    closed_orders = part(
        orders.where(_window("close_time", trade_start, trade_end) & F.col("cmd").isin(0, 1, 2, 3, 4, 5, 6) & F.col("volume_closed_usd").isNotNull()),
        "volume", F.col("volume") <= 100)
    closed_deals = part(
        deals.where(_window("time", trade_start, trade_end) & F.col("action").isin(0, 1) & (F.col("entry") == 1)),
        "volume_closed", F.col("volume_closed") >= 100)
    totals = closed_orders.union(closed_deals).groupBy("user_uid").agg(
        F.round(F.sum("volume_closed_usd"), 2).alias("sum_volume_closed_usd"),
        F.round(F.sum("profit_usd"), 2).alias("profit_usd"),
        F.sum("lot").alias("sum_volume_closed_lot"), F.max("lot").alias("max_volume_closed_lot"),
        F.count("volume_closed_usd").alias("cnt_orders_closed"),
        F.sum(F.coalesce("small", F.lit(0))).alias("cnt_closed_orders_less_1_lot"),
    )
    flows = [f"{k}_{s}_{m}" for k in ("deposit", "withdrawal") for s in ("ext", "int") for m in ("sum_usd_amt", "cnt")]
    days = (F.col("fact_date") >= F.lit(balance_start).cast("date")) & (F.col("fact_date") <= F.lit(balance_end).cast("date"))
    money = balance.where(days).groupBy("user_uid").agg(*[F.sum(c).alias(c) for c in flows])
    return totals.join(money, "user_uid", "left")


def mirror_locker_risk(features: DataFrame) -> DataFrame:
    """Peak lot, profit to deposits, and a high / medium / low class per user."""
    mean_lot = scalars.ratio(F.col("sum_volume_closed_lot"), F.col("cnt_orders_closed"))
    top_lot = F.col("max_volume_closed_lot").cast("double")
    deposits = F.col("deposit_ext_sum_usd_amt") + F.col("deposit_int_sum_usd_amt")
    mid = features.select(
        F.when((F.col("cnt_orders_closed") != 0) & (mean_lot > top_lot), mean_lot).otherwise(top_lot).alias("past_24_hr_max"),
        F.when(deposits != 0, scalars.ratio(F.col("profit_usd"), deposits)).otherwise(F.lit(0.0)).alias("profit_coef"),
        F.col("cnt_closed_orders_less_1_lot").alias("over_1_coef"), "*",
    )
    peak, coef, small = F.col("past_24_hr_max"), F.col("profit_coef"), F.col("over_1_coef")
    risk = (
        F.when((peak >= 31) & ((coef >= 0.79) | (coef <= -0.49)) & (small <= 6), F.lit("high"))
        .when((peak >= 11) & ((coef >= 0.49) | (coef <= -0.39)) & (small <= 9), F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return mid.select(risk.alias("possibility_error"), "*")


def _not_hedge_close(column: str) -> Column:
    return F.col(column).isNull() | ~F.startswith(column, F.lit(constants.HEDGE_CLOSE_PREFIX))


def round_trips(deals: DataFrame, orders: DataFrame, scoring_date: str, lookback_days: int = 1,
                *, excluded: Sequence[int], versions: Sequence[str] = ("updated", "version")) -> DataFrame:
    """Closed trades of both platforms; versions of a deal are reduced to the newest values.

    ``versions`` orders the versions of a deal: end it in a column that tells equal times apart.
    """
    day = F.lit(scoring_date).cast("date")
    first = F.date_sub(day, lookback_days)
    kept = deals.where(
        F.col("action").isin(0, 1) & F.lower("server_name").like("%real%") & _not_hedge_close("comment")
        & (F.col("date") >= first) & (F.col("date") < day) & ~F.col("login").isin(*excluded)
    )
    def last(c: str) -> Column:
        return newest(c, *versions).alias(c)

    close = kept.where((F.col("entry") == 1) & F.col("time_msc").isNotNull()).groupBy("date", "login", "position_id", "user_uid").agg(
        last("profit"), last("spread_revenue_usd"), last("xr_account_currency_to_usd"), newest("time_msc", *versions).alias("closed_at"))
    opened = kept.where(F.col("entry") == 0).groupBy("login", "position_id", "reason").agg(newest("time_msc", *versions).alias("opened_at"))
    spread = scalars.ratio(F.col("spread_revenue_usd"), F.col("xr_account_currency_to_usd")).alias("spread_in_account_cur")
    mt5 = close.join(opened, ["login", "position_id"]).select(
        F.lit("mt5").alias("mt"), "user_uid", "reason", "profit", "spread_revenue_usd", spread,
        scalars.seconds_between(F.col("opened_at"), F.col("closed_at")).alias("duration"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    mt4 = orders.where(
        F.col("open_time").isNotNull() & (F.col("close_time") > epoch) & F.col("cmd").isin(0, 1)
        & F.lower("server").like("%real%") & _not_hedge_close("comment")
        & (F.col("open_time") >= first.cast("timestamp_ntz")) & (F.col("open_time") < day.cast("timestamp_ntz"))
    ).select(
        F.lit("mt4").alias("mt"), "user_uid", "reason", "profit", "spread_revenue_usd",
        scalars.ratio(F.col("spread_revenue_usd"), F.col("open_xr_account_currency_to_usd")).alias("spread_in_account_cur"),
        scalars.seconds_between(F.col("open_time"), F.col("close_time")).alias("duration"))
    return mt4.union(mt5)


def rounder_metrics(trades: DataFrame, min_count: int = 10, profit_share: float = 0.1, spread_share: float = 0.4) -> DataFrame:
    agg = trades.groupBy("mt", "user_uid").agg(
        F.count("user_uid").alias("cnt_deals"),
        F.count_if(F.col("profit").between(-0.01, 0)).alias("cnt_0_profit_deals"),
        F.count_if(F.col("spread_in_account_cur") < 0.005).alias("cnt_0_spread_acc_cur"),
    )
    return agg.where(
        ((F.col("cnt_0_profit_deals") > min_count) | (F.col("cnt_0_spread_acc_cur") > min_count))
        & (scalars.ratio(F.col("cnt_0_profit_deals"), F.col("cnt_deals")) > profit_share)
        & (scalars.ratio(F.col("cnt_0_spread_acc_cur"), F.col("cnt_deals")) > spread_share)
    )


def rounders(deals: DataFrame, orders: DataFrame, scoring_date: str, lookback_days: int = 1, *, excluded: Sequence[int], **limits) -> DataFrame:
    """Users with many trades of no profit and no spread, stamped with the scoring date."""
    metrics = rounder_metrics(round_trips(deals, orders, scoring_date, lookback_days, excluded=excluded), **limits)
    return metrics.select(F.lit(scoring_date).cast("timestamp_ntz").alias("fact_timest"), "user_uid").distinct()


def spread_rows(deals: DataFrame, orders: DataFrame, start: str, end: str, symbols: Sequence[str] | None,
                letters: str = constants.SPREAD_SUFFIX_LETTERS) -> DataFrame:
    base = scalars.strip_suffix(F.col("symbol"), letters)
    opening = F.col("entry") == 0
    from_deals = deals.where(
        _window("time", start, end) & F.col("action").isin(0, 1) & F.col("entry").isin(0, 1, 3) & (F.col("symbol_ask") != F.col("symbol_bid"))
    ).select(
        base.alias("symbol_reg"), "contract_size",
        F.when(opening, scalars.spread_pips(F.col("symbol_ask"), F.col("symbol_bid"), F.col("digits"))).alias("spread_pips"),
        F.when(opening, scalars.spread_usd(F.col("symbol_ask"), F.col("symbol_bid"), F.col("contract_size"), F.col("xr_quote_currency_to_usd"))).alias("spread_usd"),
        F.col("volume_usd").cast("decimal(20,2)").alias("volume_usd"),
    )
    from_orders = orders.where(
        _window("open_time", start, end) & F.col("cmd").isin(0, 1) & (F.col("open_symbol_ask") != F.col("open_symbol_bid"))
    ).select(
        base.alias("symbol_reg"), "contract_size",
        scalars.spread_pips(F.col("open_symbol_ask"), F.col("open_symbol_bid"), F.col("digits")).alias("spread_pips"),
        scalars.spread_usd(F.col("open_symbol_ask"), F.col("open_symbol_bid"), F.col("contract_size"), F.col("open_xr_quote_currency_to_usd")).alias("spread_usd"),
        (F.col("volume_opened_usd") + F.col("volume_closed_usd")).cast("decimal(20,2)").alias("volume_usd"),
    )
    rows = from_deals.union(from_orders)
    return rows.where(F.col("symbol_reg").isin(*symbols)) if symbols else rows


def spread_by_instrument(deals: DataFrame, orders: DataFrame, start: str, end: str,
                         symbols: Sequence[str] | None = constants.SPREAD_SYMBOLS, exact: bool = False) -> DataFrame:
    """Volume, mean and high percentiles of the spread per symbol and account type.

    The percentiles are sketches, built in the same pass, unless ``exact``.
    """
    account = F.when((F.col("contract_size") == 1000) & (F.col("symbol_reg") != "USOIL"), F.lit("cent")).otherwise(F.lit("standart"))
    keys, spreads, qs = ["symbol_reg", "type_account", "contract_size"], {"spread_pips": "spread_pip", "spread_usd": "spread_usd"}, (0.80, 0.95)
    rows = spread_rows(deals, orders, start, end, symbols).withColumn("type_account", account)
    sums = [F.sum("volume_usd").alias("tv_sum"), *[F.avg(c).alias(f"avg_{n}") for c, n in spreads.items()]]
    names = {(c, i): f"{n}_{round(q * 100)}_perc" for c, n in spreads.items() for i, q in enumerate(qs)}
    if not exact:
        sketches = {c: F.percentile_approx(c, list(qs), 10_000) for c in spreads}
        return rows.groupBy(*keys).agg(*sums, *[sketches[c][i].alias(n) for (c, i), n in names.items()]).orderBy("tv_sum")
    # Both spreads go through one percentile pass, as (key, variable, value) rows; the joined rows are read three times.
    rows = materialize(rows, "spreads")
    found = exact_percentiles(unpivot(rows, keys, list(spreads)), [*keys, "variable"], "value", qs)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("variable") == c, F.col(f"p{i}"))).alias(n) for (c, i), n in names.items()])
    return joins.null_safe(rows.groupBy(*keys).agg(*sums), wide, keys, "left").orderBy("tv_sum")
