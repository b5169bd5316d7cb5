"""Line dedup by a log-template tree.

A line's leaf is its token count and its first tokens, with variable-looking tokens (digits,
addresses) replaced by a wildcard. Within a leaf, a token that enough lines have at the same
place is constant, any other is a variable field: the line with its variable fields replaced
is its template, unless too little of it is constant, when the template is the line itself.
Templates that recur in many places are boilerplate, and their lines are dropped.

Places are told apart by the neighbouring lines: copies of one document repeat a line in one
place, boilerplate turns up between different lines each time. Boilerplate of several lines,
or set off by blank lines, has few places but many documents. So documents are counted too,
copies set aside: of all texts with the same first line (by hash) among the lines that do not
recur themselves, one counts; texts that mostly consist of lines that do are copies of each
other, and one counts of those with the same first line among these.

Lines of fewer than ``MIN_TOKENS`` tokens are templates of their own, without fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import materialize, shared_dir

LEADING = 3  # tokens that lead to a leaf, after the token count
MIN_PLACES = 10  # a recurring template has this many different places
MIN_TOKENS = 4  # shorter lines are templates as they are
MIN_OWN = 0.5  # a text with this share of characters in lines of its own is no copy
MIN_CONSTANT, CONSTANT_SHARE = 4, 0.6  # of a template with variable fields
WILDCARD = "<*>"

_BLANKS, _UNEVEN, _VARIABLE = r"[\x20\x09-\x0D]+", r"[\x09-\x0D]|\x20\x20|\x20\z", r"[0-9@]|://"


def _mask(word: Column) -> Column:
    return F.when(word.rlike(_VARIABLE), F.lit(WILDCARD)).otherwise(word)


def _masked(words: Column) -> Column:
    return F.transform(words, _mask)


def _words(line: Column) -> Column:
    """The tokens of a line that has some. Other blanks than single spaces are rare; split knows a pattern of one character without compiling it."""
    line = _unindented(line)
    return F.split(F.when(line.rlike(_UNEVEN), F.rtrim(F.regexp_replace(line, _BLANKS, " "))).otherwise(line), " ")


def _unindented(line: Column) -> Column:
    """Empty, if the line has no tokens."""
    return F.ltrim(line, F.lit(" \t\n\u000b\f\r"))


def _tokens(line: Column) -> Column:
    return _masked(_words(line))


def _with_leaf(lines: DataFrame) -> DataFrame:
    """Lines with tokens, with their leaf, by the leading tokens. A short line is its own leaf."""
    words = lines.where(_unindented(F.col("line")) != "").withColumn("words", _words(F.col("line")))
    leading = [F.get("words", F.lit(i)) for i in range(LEADING)]
    leaf = F.when(F.size("words") >= MIN_TOKENS, F.xxhash64(F.size("words"), *map(_mask, leading))).otherwise(F.xxhash64(F.size("words"), *leading))
    return words.withColumn("leaf", leaf).drop("words")


def _placed_lines(docs: DataFrame) -> DataFrame:
    """(k, no, line, place); k stands for the text, place for the neighbouring lines."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("k"), F.split(text, "\n").alias("rows"))
    around = F.transform(
        "rows", lambda x, i: F.struct(i.alias("no"), x.alias("line"), F.xxhash64(F.get("rows", i - 1), F.lit(1), F.get("rows", i + 1)).alias("place"))
    )
    return rows.select("k", F.inline(around))


def _line_hashes(text: Column) -> Column:
    """Of the lines that are not blank."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: _unindented(x) != ""), lambda x: F.md5(x.cast("binary")))


def _documents(docs: DataFrame, placed: DataFrame, min_places: int) -> DataFrame:
    """(leaf, template, documents): the different documents, copies set aside, of templates found in ``min_places`` texts."""
    many = placed.groupBy("leaf", "template").agg(F.count_distinct("k").alias("texts")).where(F.col("texts") >= min_places).select("leaf", "template")
    often = materialize(placed.join(many, ["leaf", "template"]).select("k", "leaf", "template", "no", "raw", "chars").distinct(), "often")
    # A text's often found lines, and their characters.
    common = often.groupBy("k").agg(F.collect_set("raw").alias("common"), F.sum("chars").alias("taken"), F.min("raw").alias("first"))
    text = F.coalesce("text", F.lit(""))
    hashes = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("k"), _line_hashes(text).alias("all"), F.length(F.replace(text, F.lit("\n"), F.lit(""))).alias("length"))
    own = F.array_min(F.array_except("all", "common"))
    is_own = (F.col("length") - F.col("taken") >= MIN_OWN * F.col("length")) & own.isNotNull()
    origin = F.when(is_own, F.xxhash64(F.lit("own"), own)).otherwise(F.xxhash64(F.lit("copy"), F.col("first")))
    origins = hashes.join(common, "k").select("k", origin.alias("origin")).groupBy("k").agg(F.min("origin").alias("origin"))
    return often.select("k", "leaf", "template").distinct().join(origins, "k").groupBy("leaf", "template").agg(F.count_distinct("origin").alias("documents"))


def recurring_lines(docs: DataFrame, min_places: int = MIN_PLACES) -> DataFrame:
    """(k, no): the lines, by text key and number from 0, whose template recurs."""
    # One pass cuts the texts and writes all lines; the leaves are counted and the busy ones picked from there.
    path = shared_dir(docs.sparkSession, "cut")
    cut = _with_leaf(_placed_lines(docs))
    cut.write.option("compression", "zstd").parquet(path)
    cut = docs.sparkSession.read.schema(cut.schema).parquet(path)
    busy = cut.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_places).select("leaf")
    found = cut.join(busy, "leaf").withColumn("tokens", _tokens(F.col("line")))
    found = found.withColumns({"raw": F.md5(F.col("line").cast("binary")), "chars": F.length("line")})
    found = found.withColumn("line", F.when(F.size("tokens") < MIN_TOKENS, F.col("leaf")).otherwise(F.xxhash64("tokens")))
    found = materialize(found, "lines")
    # Tokens of each different line once, weighted by how often it occurs.
    distinct = found.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens"))
    spread = distinct.select("leaf", "line", "n", F.posexplode("tokens").alias("at", "token"))
    constant = spread.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).where((F.col("n") >= min_places) & (F.col("token") != WILDCARD)).select("leaf", "at", "token", F.lit(True).alias("constant"))
    marked = spread.join(constant, ["leaf", "at", "token"], "left")
    piece = F.struct("at", F.when(F.col("constant"), F.col("token")).otherwise(WILDCARD).alias("token"))
    lines_of = marked.groupBy("leaf", "line").agg(F.array_sort(F.collect_list(piece)).alias("t"), F.count("constant").alias("c"), F.count(F.lit(1)).alias("size"))
    enough = (F.col("c") >= MIN_CONSTANT) & (F.col("c") >= CONSTANT_SHARE * F.col("size"))
    templates = lines_of.select("leaf", "line", F.when(enough, F.xxhash64("t.token")).otherwise(F.xxhash64("leaf", "line")).alias("template"))
    placed = materialize(found.drop("tokens").join(templates, ["leaf", "line"]), "templates")
    counts = placed.groupBy("leaf", "template").agg(F.count_distinct("place").alias("places"), F.count_distinct("k").alias("texts"))
    # Half of the texts at least: edited copies of one text have a few places each.
    drop = counts.where((F.col("places") >= min_places) & (2 * F.col("places") >= F.col("texts"))).select("leaf", "template")
    drop = drop.union(_documents(docs, placed, min_places).where(F.col("documents") >= min_places).select("leaf", "template")).distinct()
    return placed.join(drop, ["leaf", "template"]).select("k", "no").distinct()


def _without(docs: DataFrame, min_places: int) -> DataFrame:
    """The rows as a struct ``row``, with all lines and the kept ones."""
    gone = recurring_lines(docs.select("text"), min_places).groupBy("k").agg(F.collect_set("no").alias("gone"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(text.cast("binary"))).alias("k"))
    joined = rows.join(gone, "k", "left").withColumn("lines", F.split(F.coalesce("row.text", F.lit("")), "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("gone", i)))
    return joined.select("row", "lines", kept.alias("kept"))


def line_report(docs: DataFrame, min_places: int = MIN_PLACES) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_chars, kept_md5 (of the remaining text).

    A NULL or empty text is one empty line, which stays. An empty table gives no rows; extra
    columns are ignored; equal texts get equal results.
    """
    text = F.array_join("kept", "\n")
    return _without(docs.select("doc_id", "text"), min_places).select(
        F.col("row.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.length(text).cast("long").alias("kept_chars"), F.md5(text.cast("binary")).alias("kept_md5"),
    )


def drop_recurring(docs: DataFrame, min_places: int = MIN_PLACES) -> DataFrame:
    """The rows of ``docs`` without recurring lines; ``n_chars``, if there, follows the text. NULL texts stay NULL."""
    names = docs.columns
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    out = {c: F.col(f"row.`{c}`") for c in names} | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.coalesce(F.length(text), F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return _without(docs, min_places).select(*[out[c].alias(c) for c in names])
