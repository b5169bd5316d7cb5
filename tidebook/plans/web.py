"""Jobs over stored pages and posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import html, text


def bank_links(pages: DataFrame) -> DataFrame:
    """Anchor text and target of every link, over all listing pages at once."""
    return html.links(pages, "html", "page_id")


def path_numbers(links: DataFrame, position: int) -> DataFrame:
    """Distinct path segments at ``position``, sorted; links without it are left out."""
    part = text.path_segment(F.col("href"), position)
    return links.select(part.alias("number")).where("number IS NOT NULL").distinct().orderBy("number")


def absolute_links(links: DataFrame, base: Column, without: Sequence[str] = ("rubric",)) -> DataFrame:
    """Site links lacking the given parts, made absolute."""
    kept = links.where(text.contains_none(F.col("href"), without))
    return kept.withColumn("link", F.when(F.col("href").like("http%"), F.col("href")).otherwise(F.concat(base, F.col("href"))))


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/]+)", 1)


def articles(pages: DataFrame) -> DataFrame:
    """Link, title and body text of every page that has both."""
    rows = html.computed(
        pages.withColumnRenamed("url", "link"), ["page_id", "link"],
        title=html.plain(html.inner(F.col("html"), "h1")), body=html.plain(html.inner(F.col("html"), "article")))
    return rows.dropna(subset=["title", "body"])


def archive_urls(first: DataFrame, template: str) -> DataFrame:
    """One listing address per day between the two dates of the one-row frame ``first(lo, hi)``."""
    days = first.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.select("day", F.format_string(template, F.date_format("day", "yyyy-MM-dd")).alias("url"))


def clean_posts(posts: DataFrame, column: str, letters: str, without: Sequence[str]) -> DataFrame:
    """Lower-case posts without reposts, mentions and links, reduced to letters, dots and commas."""
    low = posts.withColumn(column, F.lower(column)).where(text.contains_none(F.lower(column), without))
    return low.withColumn(column, text.squeeze_spaces(text.keep_letters(F.col(column), letters)))
