"""Scalar expressions on dates, money and market values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yyyymm(column: Column) -> Column:
    return F.year(column) * 100 + F.month(column)


def year_of(month_id: Column) -> Column:
    return F.floor(month_id / 100).cast("int")


def from_epoch_millis(column: Column) -> Column:
    return F.timestamp_millis(column.cast("bigint"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def decimal_comma(column: Column) -> Column:
    """'1,5' -> 1.5; anything that is no number becomes NULL."""
    return F.regexp_replace(column, ",", ".").try_cast("double")


def signed_volume(action: Column, volume: Column) -> Column:
    return F.when(action == 0, volume).when(action == 1, -volume)


def deal_direction(entry: Column, action: Column) -> Column:
    """Side of the position a deal belongs to: a closing deal has the opposite action."""
    return (
        F.when((entry == 0) & (action == 0), F.lit("buy"))
        .when((entry == 0) & (action == 1), F.lit("sell"))
        .when((entry == 1) & (action == 0), F.lit("sell"))
        .when((entry == 1) & (action == 1), F.lit("buy"))
    )


def strip_suffix(symbol: Column, letters: str) -> Column:
    """Drop one trailing account-type letter from an instrument name."""
    return F.regexp_replace(symbol, f"[{letters}]$", "")


def spread_pips(ask: Column, bid: Column, digits: Column) -> Column:
    return (ask - bid) / F.pow(F.lit(0.1), digits - 1)


def spread_usd(ask: Column, bid: Column, contract_size: Column, rate: Column) -> Column:
    return F.round((ask - bid) * (contract_size * rate), 2)


def ratio(n: Column, d: Column) -> Column:
    """n / d as a double; NULL for a zero divisor."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def float_ratio(n: Column, d: Column) -> Column:
    """Floating-point division: +-infinity for a zero divisor, NULL for 0 / 0."""
    num, den = n.cast("double"), d.cast("double")
    infinite = F.when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(float("-inf")))
    return F.when(den != 0, F.try_divide(num, den)).when(den == 0, infinite)


def annuity_payment(amount: Column, yearly_rate: Column, months: Column) -> Column:
    """Monthly payment of a loan, to the cent; equal instalments when the rate is 0."""
    i = yearly_rate.cast("double") / 1200
    growth = F.pow(1 + i, months)
    paid = F.when(i == 0, F.try_divide(amount.cast("double"), months.cast("double"))).otherwise(
        F.try_divide(amount.cast("double") * i * growth, growth - 1)
    )
    return F.round(paid, 2)


def linspace(lo: Column, hi: Column, count: int) -> Column:
    """Array of ``count`` evenly spaced values from ``lo`` to ``hi``."""
    step = (hi - lo) / F.lit(float(count - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: lo + k * step)


def month_ends(start: Column, periods: Column) -> Column:
    """Array of month-end dates, the first one in the month of ``start``."""
    months = F.sequence(F.lit(0), periods.cast("int") - 1)
    return F.transform(months, lambda k: F.last_day(F.add_months(start, k)))
