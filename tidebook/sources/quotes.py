"""Exchange quotes from stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook import constants
from tidebook.functions import html


def quotes_from_pages(pages: DataFrame, table: int = 1, *keep: str) -> DataFrame:
    """The quote table of each page: ticker, board, last price (0 where empty)."""
    rows = html.table_rows(pages, table, "html", *keep)
    price = F.coalesce(F.get("cells", 2).try_cast("double"), F.lit(0.0))
    return rows.select(*keep, F.get("cells", 0).alias("tiker"), F.get("cells", 1).alias("boardid"), price.alias("price"))


def in_session(df: DataFrame, at: str, hours: Sequence[int] = constants.SESSION_HOURS, days: Sequence[int] = constants.SESSION_DAYS) -> DataFrame:
    """Rows loaded in trading hours; days count from 0 = Sunday."""
    return df.where(F.hour(at).isin(*hours) & (F.dayofweek(at) - 1).isin(*days))


def session_load(quotes: DataFrame, at: str, price: str, hours: Sequence[int] = constants.SESSION_HOURS, days: Sequence[int] = constants.SESSION_DAYS) -> DataFrame:
    """Quotes to append: in session, with a price, stamped with the load time."""
    filled = quotes.fillna(0, subset=[price])
    return in_session(filled, at, hours, days).where(F.col(price) != 0).withColumnRenamed(at, "dt_load")
