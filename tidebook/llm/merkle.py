"""Merkle manifest of a dataset: one tree per language over its rows, and one over the languages.

Rows get their place by a range sort. A tree is climbed in blocks of ``fanout ** levels``
neighbouring nodes. Within a block every level is a handful of lag and lead columns of fixed
offset over one window: the first row of a node holds its hash, a sibling ``d`` places away
stands ``d * fanout ** level`` rows away, and columns are masked by the node's slot and by the
length of its run. First-child rows hash the parent. A block's first row goes on to the next
round as a node of the level above, so a round shuffles the rows once for ten levels, and no
task ever holds more than its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import materialize

FANOUT = 2
# Levels climbed in one round: blocks of 1,024 nodes.
LEVELS = 10
# A row whose id's checksum this divides is tampered with in the self-test of the manifest.
EVERY = 7
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated as UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text")))


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with their place 0.. in the given order, by a range sort; rows equal in it are interchangeable.

    Ranges are written once, so that a range that is read again holds the same rows. A range's
    start is the sum of the ranges before it: one number per partition.
    """
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    body = materialize(ranged.withColumn("__at", at), "ranges")
    body = body.withColumns({"__part": F.shiftright("__at", ROW_BITS), "__row": F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)}).drop("__at")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = body.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return body.join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def climb(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """``levels`` rounds of hashing inside blocks of ``fanout ** levels`` nodes.

    ``nodes`` has group, pos (0.. without gaps in its group), h and n (nodes of the group). Adds
    ``block``, ``path`` (one struct of left and right siblings for each level that the group
    has) and leaves in ``h`` of a block's first row the hash of that block.
    """
    within = Window.partitionBy("group", "block").orderBy("pos")
    rows = nodes.withColumn("block", F.floor(F.col("pos") / fanout**levels).cast("long"))
    names = list(rows.columns)
    for level in range(levels):
        step = fanout**level
        offsets = range(1, fanout)
        rows = rows.withColumns(
            {f"__lag{d}": F.lag("h", d * step).over(within) for d in offsets} | {f"__lead{d}": F.lead("h", d * step).over(within) for d in offsets})
        slot = F.floor(F.col("pos") / step) % fanout
        follows = F.col("n") - F.col("pos")  # rows from here to the end of the group
        left = F.concat(*[F.when(slot >= d, F.coalesce(f"__lag{d}", F.lit(""))).otherwise("") for d in reversed(offsets)])
        right = F.concat(*[F.when((slot + d < fanout) & (follows > d * step), F.col(f"__lead{d}")).otherwise("") for d in offsets])
        grows = F.col("n") > step  # the group still has several nodes
        first, opens = F.col("pos") % step == 0, F.col("pos") % (step * fanout) == 0
        parent = F.when(~grows, F.col("h")).when(opens, digest(F.col("h"), right))
        rows = rows.select(
            *[c for c in rows.columns if c != "h" and not c.startswith(("__lag", "__lead"))],
            F.when(grows & first, F.struct(left.alias("left"), right.alias("right"))).alias(f"__sib{level}"), parent.alias("h"))
    # Rows below a node take the siblings from its first row.
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.array_compact(F.array(*[F.last(f"__sib{i}", ignorenulls=True).over(so_far) for i in range(levels)]))
    return rows.select(*names, path.alias("path"))


def proofs(nodes: DataFrame, most: int, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """Adds to ``nodes(group, pos, h, n, ..)`` the ``path`` to the top of its group's tree, bottom up, and the ``top``.

    ``most`` is the largest ``n``. ``h`` is lost.
    """
    width = fanout**levels
    if most <= width:
        need = max(1, math.ceil(math.log(max(most, 2), fanout) + 1e-9)) if most > 1 else 1
        block = Window.partitionBy("group", "block").orderBy("pos")
        return climb(nodes, min(need, levels), fanout).withColumn("top", F.first("h").over(block)).drop("h", "block")
    below = climb(nodes, levels, fanout)
    heads = below.where(F.col("pos") % width == 0)
    tops = materialize(heads.select("group", F.col("block").alias("pos"), "h", F.ceil(F.col("n") / width).cast("long").alias("n")), "tops")
    above = proofs(tops, -(-most // width), levels, fanout).select("group", F.col("pos").alias("block"), F.col("path").alias("above"), "top")
    return below.join(above, ["group", "block"]).withColumn("path", F.concat("path", "above")).drop("h", "block", "above")


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``path``."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, every: int = EVERY) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and what the proof makes of a tampered copy.

    A leaf is the hash of doc_id, source, lang, n_chars and text. Per lang, leaves ascend by
    doc_id (NULL first, equal ids by leaf); each run of ``fanout`` nodes becomes one until one
    remains, the subroot. Subroots, NULL lang first, likewise give the root. ``proof_sha256`` is
    the hash of all siblings from the leaf to the root. Where ``every`` divides the checksum of
    the id, ``folded_root`` starts from the leaf with one more in n_chars, else from the leaf;
    ``verified`` tells whether it equals the root.

    NULLs are leaves' ``-``; a row with NULL id or n_chars is not tampered with; rows that are
    equal in all five columns are leaves of their own; an empty table has no rows. A lone
    row's leaf is its subroot and root, its proof the hash of nothing. Other columns are not read.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    more = leaf((F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)"))
    leaves = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("group"),
        leaf(F.col("n_chars")).alias("leaf"), F.when(changed, more).alias("tampered"), F.monotonically_increasing_id().alias("copy")), "leaves")
    placed = numbered(leaves, ["group", "doc_id", "leaf", "copy"], "place").drop("copy")
    sizes = materialize(placed.groupBy("group").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")), "sizes")
    groups, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    if not groups:
        return placed.selectExpr("doc_id", "leaf", "leaf AS subroot", "leaf AS root", "leaf AS proof_sha256", "leaf AS folded_root", "true AS verified")
    nodes = placed.join(sizes, "group").select("group", (F.col("place") - F.col("start")).alias("pos"), "n", "doc_id", "leaf", "tampered", F.col("leaf").alias("h"))
    rows = proofs(nodes, most, levels, fanout)
    tops = materialize(rows.where("pos = 0").select(F.col("group").alias("member"), F.col("top").alias("h")), "subroots")
    langs = numbered(tops, ["member"], "pos").select(F.lit("").alias("group"), "pos", F.lit(groups).cast("long").alias("n"), "member", "h")
    upper = proofs(langs, groups, levels, fanout).select(F.col("member").alias("group"), F.col("path").alias("upper"), F.col("top").alias("root"))
    whole = rows.join(upper, "group").withColumn("path", F.concat("path", "upper"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = whole.select("doc_id", "leaf", F.col("top").alias("subroot"), "root", digest(siblings).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
