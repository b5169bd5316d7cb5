"""Monthly buying of papers: prices, lots, holdings, dividends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook import constants
from tidebook.functions import scalars


def with_month(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"month": F.month(date), "year": F.year(date), "month_id": scalars.yyyymm(F.col(date))})


def lot_prices(prices: DataFrame, lots: DataFrame) -> DataFrame:
    """Price of one lot per paper and day."""
    return prices.join(lots, F.col("paper") == F.col("stock")).select(
        "paper", "date", scalars.yyyymm(F.col("date")).alias("month_id"), (F.col("close") * F.col("stock_in_lot")).alias("price"), "stock_in_lot")


def dividend_per_lot(dividends: DataFrame, lots: DataFrame) -> DataFrame:
    joined = dividends.join(lots, F.col("tiker") == F.col("stock")).drop("stock")
    return with_month(joined.withColumn("div_by_lot", F.col("dividend") * F.col("stock_in_lot")))


def trade_days(prices: DataFrame, seed: int = 7919) -> DataFrame:
    """One trade day per month, chosen by arithmetic on the month, so a rerun picks the same day."""
    days = prices.select("date").distinct().select("date", scalars.yyyymm(F.col("date")).alias("month_id"))
    month = Window.partitionBy("month_id")  # at most 31 rows each
    numbered = days.select("*", (F.row_number().over(month.orderBy("date")) - 1).alias("pos"), F.count(F.lit(1)).over(month).alias("n"))
    return numbered.where(F.col("pos") == F.col("month_id").cast("bigint") * seed % F.col("n")).select("month_id", "date")


def monthly_plan(prices: DataFrame, lots: DataFrame, caps: DataFrame, seed: int = 7919) -> DataFrame:
    """Papers to buy each month: priced on the month's trade day below their cap, in equal shares.

    ``caps(stock, max_buy_price)`` bounds the price of one share.
    """
    quoted = lot_prices(prices, lots).join(trade_days(prices, seed), ["month_id", "date"])
    limits = caps.select(F.col("stock").alias("paper"), "max_buy_price")
    eligible = quoted.join(limits, "paper").where(F.col("price") < F.col("max_buy_price") * F.col("stock_in_lot"))
    sizes = eligible.groupBy("month_id").agg(F.count(F.lit(1)).alias("n"))
    return eligible.join(sizes, "month_id").select("month_id", "date", "paper", "price", scalars.ratio(F.lit(1), F.col("n")).alias("share"))


def buy_ledger(plan: DataFrame) -> DataFrame:
    """One lot of every eligible paper per month."""
    return plan.select("month_id", "date", "paper", F.lit(1).alias("lots"), "price")


def cumulative_holdings(ledger: DataFrame) -> DataFrame:
    """Lots held per paper after each purchase. One row per paper and month, so a paper's window is short."""
    per_month = ledger.groupBy("paper", "month_id").agg(F.sum("lots").alias("bought"))
    upto = Window.partitionBy("paper").orderBy("month_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_month.withColumn("held", F.sum("bought").over(upto))


def holdings_by_month(ledger: DataFrame) -> DataFrame:
    """Lots held per paper in every month of the plan from its first purchase on."""
    held = cumulative_holdings(ledger)
    following = held.withColumn("next", F.lead("month_id").over(Window.partitionBy("paper").orderBy("month_id")))
    months = ledger.select("month_id").distinct()
    # The months of the plan are a short list (twelve a year), attached as one array.
    spans = following.select("paper", "held", F.col("month_id").alias("since"), F.coalesce("next", F.lit(999999)).alias("until"))
    all_months = months.agg(F.sort_array(F.collect_set("month_id"))).scalar()
    covered = F.filter("all_months", lambda m: (m >= F.col("since")) & (m < F.col("until")))
    return spans.withColumn("all_months", all_months).select("paper", "held", F.explode(covered).alias("month_id"))


def holdings_value(ledger: DataFrame, prices: DataFrame, lots: DataFrame, start_cash: float = 300000.0, monthly: float = 2000.0) -> DataFrame:
    """Per month: paid in, cash left, value of the holdings on the trade day, and the balance.

    Papers without a price on the day add nothing to the value.
    """
    days = ledger.select("month_id", "date").distinct()
    quoted = lot_prices(prices, lots).join(days, ["month_id", "date"]).select("month_id", "date", "paper", "price")
    value = holdings_by_month(ledger).join(quoted, ["month_id", "paper"]).groupBy("month_id").agg(F.sum(F.col("held") * F.col("price")).alias("value"))
    spent = ledger.groupBy("month_id", "date").agg(F.sum(F.col("lots") * F.col("price")).alias("spent"))
    # One row per month from here on.
    upto = Window.orderBy("month_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paid = F.lit(start_cash) + F.count(F.lit(1)).over(upto) * F.lit(monthly)
    fees = F.count(F.lit(1)).over(upto) * F.lit(constants.DEPOSITORY_FEE)
    bought = F.sum("spent").over(upto).cast("double") * (1 + constants.COMMISSION)
    monthly_rows = spent.join(value, "month_id", "left").withColumns({"invested": paid, "cash": paid - fees - bought})
    worth = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    return monthly_rows.select("month_id", "date", "invested", "cash", worth.alias("value"), (F.col("cash") + worth).alias("balance"))


def dividend_rows(ledger: DataFrame, dividends: DataFrame, lots: DataFrame) -> DataFrame:
    """Cash dividends after tax per month and paper, on the lots held in that month."""
    due = dividend_per_lot(dividends, lots).select("month_id", F.col("tiker").alias("paper"), "div_by_lot")
    held = holdings_by_month(ledger).join(due, ["month_id", "paper"])
    return held.where(F.col("div_by_lot") > 0).select(
        "month_id", "paper", (F.col("held") * F.col("div_by_lot")).cast("double").alias("gross"),
        (F.col("held") * F.col("div_by_lot")).alias("exact"))


def dividend_cash(ledger: DataFrame, dividends: DataFrame, lots: DataFrame) -> DataFrame:
    """Dividend cash by year, paper, month and in total, as one long table."""
    rows = dividend_rows(ledger, dividends, lots)
    labels = F.array(
        F.struct(F.lit("year").alias("grain"), scalars.year_of(F.col("month_id")).cast("string").alias("key")),
        F.struct(F.lit("month").alias("grain"), F.col("month_id").cast("string").alias("key")),
        F.struct(F.lit("paper").alias("grain"), F.col("paper").alias("key")),
        F.struct(F.lit("total").alias("grain"), F.lit("all").alias("key")),
    )
    long = rows.select(F.inline(labels), "exact")
    return long.groupBy("grain", "key").agg((F.sum("exact").cast("double") * constants.DIVIDEND_AFTER_TAX).alias("cash"))


def final_score(ledger: DataFrame, prices: DataFrame, lots: DataFrame, **money: float) -> DataFrame:
    """Balance of the last month over the money paid in (cash counted once)."""
    months = holdings_value(ledger, prices, lots, **money)
    last = months.agg(F.max_by(F.struct("month_id", "invested", "balance"), "month_id").alias("m"))
    return last.select("m.month_id", "m.invested", "m.balance", scalars.ratio(F.col("m.balance"), F.col("m.invested")).alias("score"))
