"""Cost of accounts freed from overnight swaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook import constants
from tidebook.functions import scalars
from tidebook.operators import joins
from tidebook.operators.aggregates import latest_per_day, value_counts


def zero_swaps(charged: DataFrame, start: str, end: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """Roll-overs of real accounts whose default charge is zero."""
    at = F.col("rollover_mt_time")
    rows = charged.where(
        (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
        & (F.col("rollover_default_value_usd") == 0) & F.lower("server_name").like("%real%"))
    return rows.where(F.col("symbol").isin(*symbols)) if symbols else rows


def swap_free_cost(charged: DataFrame, quotes: DataFrame, profiles: DataFrame, start: str, end: str,
                   symbols: Sequence[str] | None = constants.SWAP_SYMBOLS, profiles_between: tuple[str, str] | None = None) -> DataFrame:
    """Per month, symbol and flag: what the swap would have cost, the default, the actual charge and the loss.

    Charges are summed per day, symbol and side before they meet the quotes. Flags come from
    profile versions updated in ``profiles_between`` (half-open), or in ``start`` to ``end``.
    """
    rows = zero_swaps(charged, start, end, symbols)
    first, last = (F.lit(t).cast("timestamp_ntz") for t in profiles_between or (start, end))
    profiles = profiles.where((F.col("updated") >= first) & (F.col("updated") < last))
    flags = latest_per_day(profiles, "uid", "updated", "seq", ["muslim", "status"])
    flagged = rows.join(flags, (F.col("user_uid") == F.col("uid")) & (F.col("date") == F.col("updated_day")), "left")
    side = F.when(F.col("action") == 0, F.lit("Ask")).when(F.col("action") == 1, F.lit("Bid"))
    daily = flagged.groupBy(F.to_date("rollover_mt_time").alias("roll_date"), F.col("symbol").alias("full_symbol"), side.alias("side"), "muslim").agg(
        F.sum(F.col("volume_lots") * F.col("to_usd")).alias("lots_usd"),
        F.sum("rollover_default_value_usd").alias("default_usd"), F.sum("rollover_actual_value_usd").alias("actual_usd"))
    quoted = joins.expand_suffixes(quotes, "symbol", constants.QUOTE_SUFFIXES, "full_symbol").select(
        F.to_date("dt").alias("roll_date"), "full_symbol", "side", "value")
    priced = daily.join(quoted, ["roll_date", "full_symbol", "side"])
    charge = F.abs("value").cast("double") * F.col("lots_usd").cast("double")
    return priced.groupBy(scalars.yyyymm(F.col("roll_date")).alias("year_month"), F.col("full_symbol").alias("symbol"), "muslim").agg(
        F.sum(charge).alias("swap_charged"), F.sum("default_usd").alias("default_sum_usd"), F.sum("actual_usd").alias("actual_sum_usd"),
        (F.sum("actual_usd") - F.sum("default_usd")).alias("swap_loss_usd"))


def swap_symbol_counts(charged: DataFrame, start: str, end: str, symbols: Sequence[str] | None = constants.SWAP_SYMBOLS) -> DataFrame:
    return value_counts(zero_swaps(charged, start, end, symbols), "symbol")


def swap_symbol_coverage(charged: DataFrame, quotes: DataFrame, start: str, end: str) -> DataFrame:
    """Quoted symbols that also have roll-overs with a zero default charge."""
    used = zero_swaps(charged, start, end).select("symbol").distinct()
    return quotes.select("symbol").distinct().join(used, "symbol", "left_semi")


def swap_symbols_in_set(charged: DataFrame, start: str, end: str, symbols: Sequence[str] = constants.SWAP_SYMBOLS) -> DataFrame:
    return zero_swaps(charged, start, end, symbols).select("symbol").distinct()
