"""Loan issue and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import scalars
from tidebook.operators import joins


def issued_by_month(loans: DataFrame) -> DataFrame:
    """Amount issued in each of the twelve calendar months, 0 where there is none."""
    sums = loans.groupBy(F.month("date_begin").alias("month")).agg(F.sum("amount").alias("amount"))
    months = loans.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(sums, "month", "left").withColumn("amount", F.coalesce("amount", F.lit(0)))


def issued_by_day(loans: DataFrame) -> DataFrame:
    return joins.spine_sum(loans, "date_begin", "amount")


def loan_issuance(loans: DataFrame) -> DataFrame:
    """Issue by month and by every day, in one long table."""
    month = issued_by_month(loans).select(F.lit("month").alias("grain"), F.col("month").cast("string").alias("period"), "amount")
    day = issued_by_day(loans).select(F.lit("day").alias("grain"), F.col("day").cast("string").alias("period"), "amount")
    return month.union(day)


def loan_payments(loans: DataFrame) -> DataFrame:
    pay = scalars.annuity_payment(F.col("amount"), F.col("interest_rate_effect"), F.col("term_months"))
    return loans.withColumn("payment", pay)
