"""Column expressions over stored HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.text import squeeze_spaces

ANCHOR = r"(?is)<a\s[^>]*?href\s*=.*?</a>"
HREF = (r'(?i)href\s*=\s*"([^"]*)"', r"(?i)href\s*=\s*'([^']*)'", r"(?i)href\s*=\s*([^\s\"'>]+)")
INLINE = r"(?i)</?(?:a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|u)(?:\s[^>]*)?>"
CELL_END = r"(?is)</t[dhr][\s>].*$"
SCRIPT = r"(?s)<script[^>]*>.*?</script>"


# The named character references that are decoded; the ampersand comes last.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "middot": "\u00b7", "bull": "\u2022",
    "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "laquo": "\u00ab", "raquo": "\u00bb", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c",
    "rdquo": "\u201d", "euro": "\u20ac", "deg": "\u00b0", "times": "\u00d7", "amp": "&",
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def non_empty(column: Column) -> Column:
    return once(column, lambda c: F.when(c != "", c))


def strip_tags(column: Column) -> Column:
    """Text without tags: inline tags vanish, others become a blank."""
    return F.regexp_replace(F.regexp_replace(column, INLINE, ""), "<[^>]+>", " ")


def decode(column: Column) -> Column:
    """Named (``ENTITIES``) and numeric character references as characters."""
    return once(column, lambda c: F.when(F.contains(c, F.lit("&")), _decoded(c)).otherwise(c))


def _decoded(column: Column) -> Column:
    def character(number: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")

    def in_base(text: Column, pattern: str, prefix: str, base: int) -> Column:
        return F.aggregate(
            F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), text,
            lambda acc, n: F.replace(acc, F.concat(F.lit(prefix), n, F.lit(";")), character(F.conv(n, base, 10).cast("long"))))

    out = in_base(in_base(column, r"&#(\d{1,6});", "&#", 10), r"&#x([0-9A-Fa-f]{1,5});", "&#x", 16)
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


def _marked(column: Column, tag: str) -> Column:
    """The page cut before every ``<tag ..>`` and ``</tag>``: one pass over the page."""
    return F.split(column, f"(?i)(?=</?{tag}[\\s>/])")


def _span(pieces: Column, tag: str, number: int) -> Column:
    """(first, last): the pieces that begin with the ``number``-th opening tag (from 0) and with the tag that closes it.

    A fold over the tags that counts the depth, so elements inside the element are passed over. An
    element that is never closed ends at the last closing tag in it; without one, ``last`` is -1.
    """
    opens, closes = f"(?i)^<{tag}[\\s>/]", f"(?i)^</{tag}"
    signs = F.transform(pieces, lambda p: F.when(p.rlike(closes), -1).when(p.rlike(opens), 1).otherwise(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen"), F.lit(0).alias("depth"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(state: Column, sign: Column) -> Column:
        begins = (sign == 1) & (state["seen"] == number) & (state["first"] < 0)
        inside = state["depth"] > 0
        return F.struct(
            (state["at"] + 1).alias("at"), (state["seen"] + (sign == 1).cast("int")).alias("seen"),
            F.when(begins, 1).when(inside, state["depth"] + sign).otherwise(0).alias("depth"),
            F.when(begins, state["at"]).otherwise(state["first"]).alias("first"),
            F.when(inside & (sign == -1), state["at"]).otherwise(state["last"]).alias("last"))

    return F.aggregate(signs, start, step, lambda s: F.struct(s["first"], s["last"]))


def _after_tag(piece: Column) -> Column:
    return F.regexp_replace(piece, "(?s)^[^>]*>", "")


def inner(column: Column, tag: str, number: int = 0) -> Column:
    """What the ``number``-th ``<tag ..>`` (from 0) holds up to the ``</tag>`` that closes it, NULL when empty, missing or never closed."""

    def content(pieces: Column, span: Column) -> Column:
        own = _after_tag(F.get(pieces, span["first"]))
        rest = F.array_join(F.slice(pieces, span["first"] + 2, span["last"] - span["first"] - 1), "")
        return F.when((span["first"] >= 0) & (span["last"] > span["first"]), F.concat(own, rest))

    return non_empty(once(_marked(column, tag), lambda pieces: once(_span(pieces, tag, number), lambda span: content(pieces, span))))


def plain(column: Column) -> Column:
    return non_empty(squeeze_spaces(decode(strip_tags(column))))


def computed(rows: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    """``keep`` and the fields, each computed once: filters on a field do not go below it."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))


def links(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """One row per closed anchor with a target: its position on the page, target and text, decoded."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(f"({ANCHOR})"), F.lit(1))
    target = F.lit("")
    for pattern in reversed(HREF):
        target = _first_found(pattern, target)
    rows = pages.select(*keep, F.posexplode(anchors).alias("pos", "anchor"))
    return computed(rows, [*keep, "pos"], href=decode(target), text=F.trim(decode(strip_tags(F.col("anchor")))))


def _first_found(pattern: str, otherwise: Column) -> Column:
    return once(F.regexp_extract("anchor", pattern, 1), lambda found: F.when(found != "", found).otherwise(otherwise))


def scripts(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    blocks = F.regexp_extract_all(F.col(html), F.lit(f"({SCRIPT})"), F.lit(1))
    return pages.select(*keep, F.posexplode(blocks).alias("pos", "script"))


def table_text(column: Column, number: int) -> Column:
    """The ``number``-th table of a page (from 0, nested ones count) without its own tag; tables inside it keep their text only.

    Tags of rows and cells of the nested tables become blanks, so those that are left are the table's own.
    """
    names = "(?:table|caption|thead|tbody|tfoot|tr|td|th)"

    def flat(pieces: Column, span: Column) -> Column:
        own = _after_tag(F.get(pieces, span["first"]))
        rest = F.slice(pieces, span["first"] + 2, span["last"] - span["first"] - 1)
        # Depth within the table in front of each piece; a closing tag ends what its piece belongs to.
        state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

        def step(s: Column, piece: Column) -> Column:
            closes = piece.rlike("(?i)^</table")
            depth = s["depth"] + F.when(closes, -1).otherwise(1)
            bare = F.regexp_replace(piece, f"(?i)</?{names}[^>]*>", " ")
            return F.struct(depth.alias("depth"), F.concat(s["text"], F.when(depth > 0, bare).otherwise(F.concat(F.lit(" "), _after_tag(piece)))).alias("text"))

        nested = F.aggregate(rest, state, step, lambda s: s["text"])
        return F.when((span["first"] >= 0) & (span["last"] > span["first"]), F.concat(own, nested))

    return once(_marked(column, "table"), lambda pieces: once(_span(pieces, "table", number), lambda span: flat(pieces, span)))


def table_rows(pages: DataFrame, number: int, html: str = "html", *keep: str) -> DataFrame:
    """Rows of the ``number``-th table (from 0) of each page that have cells, the cells as an array of plain text.

    Rows and cells end where the next one begins, so closing tags may be missing. Nested tables
    are part of the text of their cell, and tables of their own with their own number.
    """
    begins = "(?i)(?=<{}[\\s>/])"
    rows = F.split(table_text(F.col(html), number), begins.format("tr"))
    cells = F.filter(F.split("row", begins.format("t[dh]")), lambda c: c.rlike("(?i)^<td"))
    found = pages.select(*keep, F.posexplode(F.filter(rows, lambda r: r.rlike("(?i)^<tr"))).alias("pos", "row"))
    return computed(found, [*keep, "pos"], cells=F.transform(cells, lambda c: F.trim(decode(strip_tags(F.regexp_replace(c, CELL_END, "")))))).where(F.size("cells") > 0)
