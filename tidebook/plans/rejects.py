"""Jobs over order-response events: who is rejected, how often and when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook import constants
from tidebook.functions import scalars, text
from tidebook.operators import windows


def on_day(events: DataFrame, day: str | None) -> DataFrame:
    """Events of one day (all days when None). A plain filter on ``date``, so partitions are pruned."""
    return events.where(F.col("date") == F.lit(day).cast("date")) if day else events


def reject_leaders(responses: DataFrame, comment: str = constants.REJECT_COMMENT, day: str | None = None) -> DataFrame:
    hits = on_day(responses, day).where(F.col("comment") == comment)
    return hits.groupBy("uuid").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "uuid")


def top_rejected(responses: DataFrame, k: int, comment: str = constants.REJECT_COMMENT, day: str | None = None) -> DataFrame:
    """The ``k`` most rejected users and their rank; the window sees only these ``k`` rows."""
    top = reject_leaders(responses, comment, day).limit(k)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("cnt"), "uuid")))


def user_trades(trades: DataFrame, users: DataFrame, since: str) -> DataFrame:
    """Trades of the given users with price change and duration in seconds."""
    kept = trades.where(F.col("cmd").isin(0, 1) & (F.col("open_time") >= F.lit(since).cast("timestamp_ntz")))
    chosen = users.select(F.col(users.columns[0]).cast("bigint").alias("__u"))
    return kept.join(chosen, F.col("user_uid") == F.col("__u"), "left_semi").select(
        "user_uid", "account_currency", "symbol", "volume", "cmd", "open_price",
        F.col("open_time").alias("deal_time"), F.to_date("open_time").alias("dt"), "close_price",
        (F.col("close_price") - F.col("open_price")).alias("price_change"), "profit", "open_time", "close_time",
        scalars.seconds_between(F.col("open_time"), F.col("close_time")).alias("duration_sec"),
        "close_xr_account_currency_to_usd", "spread_revenue_usd", "open_xr_account_currency_to_usd",
    )


def top_rejected_profit(trades: DataFrame, responses: DataFrame, since: str, below_rank: int = 20, **kw) -> DataFrame:
    """Profit of the most rejected users (ranks under ``below_rank``).

    Trades are summed per user before the join, so a hot user is one row by then.
    """
    top = top_rejected(responses, below_rank - 1, **kw).select(F.col("uuid").cast("bigint").alias("user_uid"), "rn")
    kept = trades.where(F.col("cmd").isin(0, 1) & (F.col("open_time") >= F.lit(since).cast("timestamp_ntz")))
    sums = kept.join(top.select("user_uid"), "user_uid", "left_semi").groupBy("user_uid").agg(F.sum("profit").alias("profit"))
    return sums.join(top, "user_uid").select("user_uid", "rn", "profit").orderBy("rn")


def response_breakdown(responses: DataFrame, results: Sequence[int] = (2,), day: str | None = None) -> DataFrame:
    kept = on_day(responses, day).where(F.col("response_result").isin(*results))
    return kept.groupBy("response_result", "comment").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "comment")


def reject_streaks(responses: DataFrame, more_than: int = 100, comment: str = constants.REJECT_COMMENT, day: str | None = None) -> DataFrame:
    """Accounts whose rejects directly follow one another more than ``more_than`` times."""
    found = windows.repeated_value_streaks(
        on_day(responses, day), ["uuid", "login"], ["request_ts", "event_id"], "comment", comment)
    return found.where(F.col("max_incidents") > more_than).orderBy(F.desc("max_incidents"), "uuid", "login")


def reject_share(responses: DataFrame, more_than: int = 10, day: str | None = None) -> DataFrame:
    counts = on_day(responses, day).where(F.col("uuid") != "").groupBy("login").agg(
        F.count_if(F.col("response_result") == 2).alias("cnt_reset_req"), F.count(F.lit(1)).alias("cnt_req"))
    kept = counts.where(F.col("cnt_reset_req") > more_than)
    return kept.withColumn("part_reset_req", scalars.ratio(F.col("cnt_reset_req"), F.col("cnt_req"))).orderBy(
        F.desc("part_reset_req"), F.desc("cnt_reset_req"))


def busy_logins(responses: DataFrame, at: Column, more_than: int = 1) -> DataFrame:
    kept = responses.where(F.col("response_result").isin(1, 2, 3) & (F.col("uuid") != ""))
    return kept.groupBy(at.alias("scoring_time"), "login").agg(
        F.count_if(F.col("response_result") == 2).alias("cnt_reset_req"), F.count(F.lit(1)).alias("cnt_req"),
    ).where(F.col("cnt_reset_req") > more_than)


def reject_minutes(responses: DataFrame, bucket: str = "minute", more_than: int = 1, day: str | None = None) -> DataFrame:
    """Per time bucket: accounts rejected more than ``more_than`` times in it."""
    logins = busy_logins(on_day(responses, day), F.date_trunc(bucket, "request_ts").cast("timestamp_ntz"), more_than)
    return logins.groupBy("scoring_time").agg(F.count("login").alias("cnt_logins")).orderBy("scoring_time")


def toxicity_counts(events: DataFrame, payload: str, start: int = 28, length: int = 5, drop: Sequence[str] = (",", '"'), limit: int | None = None, day: str | None = None) -> DataFrame:
    """Deals per toxicity value; the value is cut out of the payload by position.

    ``limit`` restricts the job to a preview of that many rows, the first by all columns.
    """
    rows = on_day(events, day)
    rows = rows.orderBy(*rows.columns).limit(limit) if limit else rows
    value = text.number_from_substring(F.col(payload), start, length, drop)
    return rows.groupBy(value.alias("toxicity")).agg(F.count(F.lit(1)).alias("cnt_deal")).orderBy(F.desc("cnt_deal"), "toxicity")
