"""User statistics: countries, the best trader, the first-month funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import scalars
from tidebook.operators.aggregates import top_with_ties, unpivot
from tidebook.operators.percentiles import exact_percentiles
from tidebook.operators.windows import first_row

TRADE_ORDER = ["open_time", "close_time", "order_id", "line_no", "profit_usd"]


def registrations(users: DataFrame) -> DataFrame:
    """One row per user: the first registration."""
    return first_row(users, ["user_id"], ["registration_time", "country_code"], ["country_code", "registration_time"])


def country_stats(users: DataFrame, balance: DataFrame) -> DataFrame:
    """Users, users with operations, and mean operation amounts by country.

    Operations are summed per user before the join, which then is one row to one row; the
    distinct counts become plain counts.
    """
    deposit = F.when(F.col("operation_type") == "deposit", F.col("operation_amount_usd"))
    withdrawal = F.when(F.col("operation_type") == "withdrawal", F.col("operation_amount_usd"))
    per_user = balance.groupBy("user_id").agg(
        F.sum(deposit).alias("dep"), F.count(deposit).alias("dep_n"), F.sum(withdrawal).alias("wd"), F.count(withdrawal).alias("wd_n"),
        F.lit(1).alias("seen"))
    joined = registrations(users).join(per_user, "user_id", "left")
    return joined.groupBy("country_code").agg(
        F.count("user_id").alias("cnt_users"), F.count("seen").alias("cnt_users_with_money"),
        scalars.ratio(F.sum("dep"), F.sum("dep_n")).alias("avg_deposit"),
        scalars.ratio(F.sum("wd"), F.sum("wd_n")).alias("avg_withdrawal"),
    ).orderBy(F.desc_nulls_last("cnt_users"), "country_code")


def trader_totals(trades: DataFrame) -> DataFrame:
    """Per user: deals, winning deals, profit, and the most traded, best and worst symbol (ties by name)."""
    by_symbol = trades.groupBy("user_id", "symbol").agg(
        F.count("profit_usd").alias("cnt_deals"), F.count_if(F.col("profit_usd") > 0).alias("cnt_profit_deals"), F.sum("profit_usd").alias("sum_profit"))
    return by_symbol.groupBy("user_id").agg(
        F.sum("sum_profit").alias("sum_profit"), F.sum("cnt_deals").alias("cnt_deals"), F.sum("cnt_profit_deals").alias("cnt_profit_deals"),
        F.min_by("symbol", F.struct(-F.col("cnt_deals"), F.col("symbol"))).alias("symbol_populare"),
        F.min_by("symbol", F.struct(-F.col("sum_profit"), F.col("symbol"))).alias("symbol_profit"),
        F.min_by("symbol", F.struct(F.col("sum_profit"), F.col("symbol"))).alias("symbol_loss"),
    )


def top_trader_profile(trades: DataFrame, users: DataFrame) -> DataFrame:
    """The most profitable user (all of them on a tie). A user registered twice counts twice."""
    best = top_with_ties(trader_totals(trades), "sum_profit")
    joined = best.join(users.select("user_id", F.col("country_code").alias("country")), "user_id")
    return joined.groupBy("user_id", "country", "symbol_populare", "symbol_profit", "symbol_loss").agg(
        F.sum("sum_profit").alias("sum_profit"), F.sum("cnt_deals").alias("cnt_deals"), F.sum("cnt_profit_deals").alias("cnt_profit_deals"))


def user_funnel(users: DataFrame, trades: DataFrame, balance: DataFrame, days: int = 30) -> DataFrame:
    """Per user: first trade, first deposit, totals of the first ``days`` days, lifetime profit.

    First rows are aggregates rather than windows, and facts are pre-summed per user and time
    before they meet the registrations, so a hot user shrinks before each shuffle; what is left
    of one is split by AQE, which ``session.tune`` lets do so before the group-by. As given,
    the early totals have no lower bound and count once per registration of the user.
    """
    first = F.min_by(F.struct("profit_usd", "open_time"), F.struct(*TRADE_ORDER))
    life = trades.groupBy("user_id").agg(first.alias("t"), F.sum("profit_usd").alias("total_profit"))

    deposits = balance.where(F.col("operation_type") == "deposit").groupBy("user_id", "operation_time").agg(
        F.sum("operation_amount_usd").alias("amount"))
    first_deposit = deposits.groupBy("user_id").agg(F.min_by(F.struct("amount", "operation_time"), "operation_time").alias("d"))

    limit = F.col("registration_time").cast("timestamp_ntz") + F.make_dt_interval(F.lit(days))
    seen = users.groupBy("user_id", limit.alias("until")).agg(F.count(F.lit(1)).alias("times"))
    early_trades = trades.groupBy("user_id", F.col("close_time").alias("at")).agg(F.sum("profit_usd").alias("profit"))
    profit = early_trades.join(seen, "user_id").where(F.col("until") >= F.col("at")).groupBy("user_id").agg(
        F.sum(F.col("profit") * F.col("times")).alias("profit_30_days"))

    def of(kind: str):
        return F.sum(F.when(F.col("operation_type") == kind, F.col("operation_amount_usd")).otherwise(0))

    early_balance = balance.groupBy("user_id", F.col("operation_time").alias("at")).agg(of("deposit").alias("dep"), of("withdrawal").alias("wd"))
    money = early_balance.join(seen, "user_id").where(F.col("until") >= F.col("at")).groupBy("user_id").agg(
        F.sum(F.col("dep") * F.col("times")).alias("deposit_30_days"), F.sum(F.col("wd") * F.col("times")).alias("withdrawal_30_days"))

    joined = registrations(users)
    for part in (life, first_deposit, profit, money):
        joined = joined.join(part, "user_id", "left")
    return joined.select(
        "user_id", F.col("country_code").alias("country"), "registration_time",
        F.col("t.profit_usd").alias("first_deal_profit"), F.col("t.open_time").alias("first_deal_open_time"),
        F.col("d.amount").alias("sum_first_deposit"), F.col("d.operation_time").alias("dt_first_deposit"),
        "profit_30_days", "deposit_30_days", "withdrawal_30_days", "total_profit",
    )


def funnel_ratios(funnel: DataFrame) -> DataFrame:
    return funnel.withColumns({
        "prcnt_profit": scalars.float_ratio(F.col("profit_30_days"), F.col("deposit_30_days")),
        "prcnt_withdrawal": scalars.float_ratio(F.col("withdrawal_30_days"), F.col("deposit_30_days")),
    })


def drop_outlier_users(df: DataFrame, metrics: Sequence[str], q: float = 0.975) -> DataFrame:
    """Remove every user above the ``q`` percentile in any metric. ``df`` is read several times."""
    edges = exact_percentiles(unpivot(df, [], metrics), ["variable"], "value", [q])
    row = edges.agg(*[F.max(F.when(F.col("variable") == m, F.col("p0"))).alias(m) for m in metrics])
    marked = df.select("user_id", *metrics).withColumn("__edge", row.select(F.struct(*metrics)).scalar())
    above = F.lit(False)
    for m in metrics:
        above = above | F.coalesce(F.col(m).cast("double") > F.col(f"__edge.{m}"), F.lit(False))
    return df.join(marked.where(above).select("user_id"), "user_id", "left_anti")
