"""Stored pages and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import query
from tidebook.catalog.reports import LINKS_SQL, decoded_sql
from tidebook.functions import html, text
from tidebook.plans import web


@query("html_links", LINKS_SQL + "SELECT page_id, pos, href, text FROM links")
def _(t):
    return html.links(t.pages, "html", "page_id")


@query("link_filter", LINKS_SQL + """
SELECT l.page_id, l.pos, CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(p.url, '^(https?://[^/]+)', 1) || href END AS link
FROM links l JOIN pages p ON p.page_id = l.page_id WHERE NOT contains(href, 'tion')""")
def _(t):
    links = html.links(t.pages, "html", "page_id", "url")
    return web.absolute_links(links, web.site_of(F.col("url")), ("tion",)).select("page_id", "pos", "link")


@query("html_field", f"""
SELECT page_id, NULLIF(trim(regexp_replace({decoded_sql("h")}, '\\s+', ' ', 'g')), '') AS title FROM (SELECT page_id, regexp_extract(html, '(?s)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1) AS h FROM pages)""")
def _(t):
    return t.pages.select("page_id", html.plain(html.inner(F.col("html"), "h1")).alias("title"))


@query("html_nested_field", """
SELECT page_id, 'One ' || page_id || ' in ' || url || ' end' AS outer_text, 'in ' || url AS inner_text, CAST(NULL AS VARCHAR) AS missing FROM pages""")
def _(t):
    page = F.concat(
        F.lit("<body><articles>no</articles><ARTICLE id='1'>One <b>"), F.col("page_id"), F.lit("</b><p><article>in "), F.col("url"),
        F.lit("</article></p><article></article>end</Article><article>later</article>"))
    pages = t.pages.select("page_id", page.alias("page"))
    return html.computed(pages, ["page_id"], **{name: html.plain(html.inner(F.col("page"), "article", n)) for name, n in (("outer_text", 0), ("inner_text", 1), ("missing", 9))})


@query("page_scripts", """
SELECT page_id, CAST(z[1] AS INT) AS pos, z[2] AS script FROM (
  SELECT page_id, unnest(list_zip(range(len(x)), x)) AS z FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>.*?</script>') AS x FROM pages))""")
def _(t):
    return html.scripts(t.pages, "html", "page_id")


@query("paged_union", LINKS_SQL + "SELECT href, COUNT(*) AS cnt, COUNT(DISTINCT page_id) AS on_pages FROM links GROUP BY href")
def _(t):
    return web.bank_links(t.pages).groupBy("href").agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("page_id").alias("on_pages"))


@query("archive_urls", """
SELECT CAST(day AS DATE) AS day, 'https://news.example.com/archive/' || strftime(day, '%Y-%m-%d') AS url
FROM (SELECT unnest(generate_series(MIN(CAST(o_orderdate AS DATE)), MAX(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS day FROM orders)""")
def _(t):
    ends = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    return web.archive_urls(ends, "https://news.example.com/archive/%s")


@query("tokenize", """
SELECT token, COUNT(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM documents) GROUP BY token""")
def _(t):
    return t.documents.select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
