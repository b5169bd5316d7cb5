"""Jaccard self-join on word shingles, by grouped prefixes.

Two sets with Jaccard similarity t or more share an element among the first
n - ceil(t n) + 1 of each, whatever the order of elements, and k of them among that many and
k - 1 more. A prefix has these k - 1 more elements (shingles that many documents share come
last), so a document that has fewer than k elements of its prefix in common with others is left
out at once. Equal sets are one class; classes with the same prefix and size are one group.
Groups that share a prefix element are candidates:

1. Per (element, size class) one group leads; every group is paired with its main leader, and
   every class with the first of its group. These pairs are few, and join most of what belongs
   together.
2. Of the others only groups count that share k elements with other components. Of these
   elements the k - 1 that most groups hold are dropped; pairs of groups that do not lie in one
   component, share one of the rest and pass the size and position filters are expanded to
   members and verified as well.

So no link between components is lost, groups of thousands of near copies need no pairs
among themselves, and a few shingles that documents share by chance make no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import materialize
from tidebook.llm.components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4
# A prefix is longer by a part of the set's size, and similar sets share that many elements of it.
EXTRA = 8
# Most shingles that are moved to the end of the order (16 bytes each, sent to every task).
COMMON = 200_000
# Members of one verification step; a group of more is spread over several.
MEMBERS = 512
# Most rows (ids with some numbers, 64 bytes each) that are sent to every task in place of shuffling texts, and bits of the filter for more.
SENT, BITS = 500_000, 1 << 25
# Words and groups that a worker remembers (some 200 and 100 bytes each), and rows that it holds at a time.
MEMORY, GROUPS, ROWS = 200_000, 100_000, 500

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMORY:
            self[word] = value
        return value


_words = _Words()


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased, split at ASCII blanks)."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, parts), np.uint64, n)
    k = min(words, n)
    h = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        h = (h ^ ids[j : n - k + 1 + j]) * _M1
        h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return np.unique(h)


def least_common(n: int) -> int:
    """How many elements the prefixes of a set of ``n`` and of a similar one that is not smaller share at least."""
    return -(-n // EXTRA)


def prefix_size(n: int) -> int:
    return n - -(-n * NUMERATOR // DENOMINATOR) + least_common(n)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is at least NUMERATOR / DENOMINATOR (3 / 4)."""
    if not len(x) or not len(y):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common)


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, their place at the end of the order): shingles that are frequent within a few thousand rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 4 * ROWS):
            seen, sets = set(), []
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                key = xxhash.xxh3_64_intdigest(s.tobytes())
                if key not in seen:
                    seen.add(key)
                    sets.append(s)
            values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= 3
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["h", "c"])

    counted = docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = counted.orderBy(F.desc("c"), "h").limit(COMMON).collect()
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(top) - np.arange(len(top)))[order]


def _describe(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: doc_id, n, its set's key, its group's key, and the prefix once per group and task."""
    hashes, places = common

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in _sliced(batches):
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n = len(s)
                if not n:
                    out.append((0, None, None, None, None))
                    continue
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                late = np.zeros(n, np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    late = np.where(hashes[at] == s, places[at], 0)
                p = s[np.argsort(late, kind="stable")][: prefix_size(n)].view(np.int64)
                group = xxhash.xxh3_64_intdigest(p.tobytes(), seed=n) - 2**63
                out.append((n, (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, group, None if group in sent else p))
                if len(sent) < GROUPS:
                    sent.add(group)
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n", "k1", "k2", "g", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(describe, "doc_id long, n long, k1 long, k2 long, g long, prefix array<bigint>")


def _with_texts(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``ids`` (with a column id) and the text of each, from ``texts(id, text)``. Few ids are sent to the texts.

    Of more a bitmap of their hashes is sent (``BITS`` / 8 bytes, whatever their number), so that few texts without an id among them are shuffled.
    """
    if ids.count() <= SENT:
        return texts.join(F.broadcast(ids), "id")

    def place(df: DataFrame) -> DataFrame:
        h = F.pmod(F.xxhash64("id"), F.lit(BITS)) + 1
        return df.withColumn("__part", F.bitmap_bucket_number(h)).withColumn("__bit", F.bitmap_bit_position(h))

    # Dealt by part first, so that each part's bits are set in one task.
    parts = place(ids.select("id").distinct()).repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod("__bit", F.lit(8)).cast("int")) == 1
    return place(texts).join(F.broadcast(parts), "__part").where(held).select("id", "text").join(ids, "id")


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of ids that are similar. ``a``'s text is sent once per ``MEMBERS`` partners."""
    sized = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("__n")), "a")
    salted = sized.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("__n") / MEMBERS)).cast("int").alias("salt"))
    salted = materialize(salted, f"{name}-pairs")
    sides = salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id")).distinct().unionByName(
        salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders = None, []
        for batch in _sliced(batches):
            found = []
            for a, salt, role, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, salt) != key:
                    key, leaders = (a, salt), []
                s = shingles(text)
                if role == 0:
                    leaders.append(s)
                elif any(linked(x, s) for x in leaders):
                    found.append((a, i))
            columns = list(zip(*found)) if found else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    rows = _with_texts(sides, texts).select("a", "salt", "role", "id", "text")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return materialize(dealt.mapInArrow(verify, "a long, b long"), f"{name}-links")


def _renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"{c}0" for c in df.columns])


def _up(n: Column, by: int) -> Column:
    return F.floor((n + (by - 1)) / by)


def _least_common(n: Column) -> Column:
    return _up(n, EXTRA)


def _prefix_size(n: Column) -> Column:
    return n - _up(n * NUMERATOR, DENOMINATOR) + _least_common(n)


def _overlap(n: Column, m: Column) -> Column:
    """What similar sets of these sizes share at least: 6/7 of the mean size."""
    return F.ceil((n + m) * NUMERATOR / (NUMERATOR + DENOMINATOR))


def _in_prefixes(n: Column, m: Column) -> Column:
    """How many elements the prefixes of similar sets of these sizes share at least: the rest of the overlap fits behind one of them."""
    return _overlap(n, m) - F.greatest(n - _prefix_size(n), m - _prefix_size(m))


def _similar_size(n: Column, m: Column) -> Column:
    return (n * NUMERATOR <= m * DENOMINATOR) & (m * NUMERATOR <= n * DENOMINATOR)


def _fits(x: str, y: str) -> Column:
    """Whether sets of these sizes can be similar, if this is the first element that they share.

    What they share is then at or behind its position in both, and must be 6/7 of the mean size.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return _similar_size(n, m) & (F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) >= _overlap(n, m))


def _needed(n: Column) -> Column:
    """How many elements of its prefix a set shares with the prefix of any similar set: these are at least 3/4 as large."""
    return _least_common(_up(n * NUMERATOR, DENOMINATOR))


def _by_two(df: DataFrame, low: str, high: str) -> DataFrame:
    """The rows whose element has more than one value of ``low`` to ``high``."""
    per_element = Window.partitionBy("element")
    return df.withColumn("__lo", F.min(low).over(per_element)).withColumn("__hi", F.max(high).over(per_element)).where("__lo <> __hi").drop("__lo", "__hi")


def _enough(df: DataFrame) -> DataFrame:
    """The rows of groups that have as many of them as a link needs."""
    return df.withColumn("__s", F.count(F.lit(1)).over(Window.partitionBy("g", "n"))).where(F.col("__s") >= _needed(F.col("n"))).drop("__s")


def _shared_elements(described: DataFrame) -> DataFrame:
    """(element, g, n, pos): the elements of prefixes that two or more groups share, for groups that have enough of them."""
    # Size and position travel as one number.
    at = F.shiftleft("n", 32) + F.col("pos")
    elements = described.where("prefix IS NOT NULL").select(F.posexplode("prefix").alias("pos", "element"), "g", "n").select("element", "g", at.alias("at"))
    shared = _by_two(elements, "g", "g").distinct().select("element", "g", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(2**32 - 1).alias("pos"))
    return _by_two(_enough(shared), "g", "g")


def _meetings(rest: DataFrame) -> DataFrame:
    """(g, n, g0, n0): pairs of groups that do not lie in one component and share an element of ``rest``, once for each run of shared elements."""
    x, y = rest.alias("x"), rest.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    first = F.struct("x.n", "x.g") < F.struct("y.n", "y.g")
    apart = (F.col("x.c0") != F.col("y.c0")) | (F.col("x.c0") != F.col("x.c1")) | (F.col("y.c0") != F.col("y.c1"))
    fit = _similar_size(n, m) & (F.least("x.left", "y.left") >= _in_prefixes(n, m))
    # A pair that shares the element before as well has met there.
    new = F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))
    return x.join(y, (F.col("x.element") == F.col("y.element")) & first & apart & fit & new).select(
        F.col("x.g").alias("g"), F.col("x.n").alias("n"), F.col("y.g").alias("g0"), F.col("y.n").alias("n0")
    )


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links).

    A NULL, empty or blank text has no shingles and links with nothing. Rows that share an id
    are one document (linked if any of their texts is). A NULL id is returned with a NULL
    component. An empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(_describe(rows, _common_shingles(rows)), "prefixes")
    usable = described.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("g").alias("g"))
    classes = materialize(classes, "classes")
    groups = classes.groupBy("g", "n").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("members"))

    shared = materialize(_shared_elements(described), "shared")

    busy = shared.select("g", "n").distinct().unionByName(groups.where("members > 1").select("g", "n")).distinct()
    members = materialize(classes.join(busy, ["g", "n"]).select("g", "n", "rep"), "members")
    texts = rows.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    texts = materialize(_with_texts(members.select(F.col("rep").alias("id")).distinct(), texts).select("id", "text"), "texts")

    # Step 1: every group with the one that leads most of its (element, size class) lists, twice
    # with shifted classes. A list is led by the group in which the element comes first: it has
    # the fewest rare elements, as the origin of edited copies does.
    log_size = F.log(F.col("n").cast("double")) / math.log(DENOMINATOR / NUMERATOR)
    stars = None
    for shift in (0.0, 0.5):
        by = shared.where(F.col("pos") <= F.col("n") - _up(F.col("n") * NUMERATOR, DENOMINATOR)).withColumn("s", F.floor(log_size + shift))
        lead = by.groupBy("element", "s").agg(F.min(F.struct("pos", "g", "n")).alias("y"))
        led = by.alias("x").join(lead, ["element", "s"]).where(_fits("x", "y") & ((F.col("x.g") != F.col("y.g")) | (F.col("x.n") != F.col("y.n"))))
        pairs = led.groupBy(F.col("x.g").alias("g"), F.col("x.n").alias("n"), F.col("y.g").alias("g0"), F.col("y.n").alias("n0")).agg(F.count(F.lit(1)).alias("c"))
        best = pairs.groupBy("g", "n").agg(F.max(F.struct("c", "g0", "n0")).alias("b")).select("g", "n", "b.g0", "b.n0")
        stars = best if stars is None else stars.unionByName(best).distinct()
    heads = groups.select("g", "n", "head")
    between = stars.join(heads, ["g", "n"]).join(_renamed(heads), ["g0", "n0"]).select(*_ordered(F.col("head"), F.col("head0")))
    within = members.join(heads, ["g", "n"]).select(F.col("head").alias("a"), F.col("rep").alias("b"))
    links = _verified(between.unionByName(within).where("a <> b").distinct(), texts, "star")

    # Step 2: groups that share elements and do not lie in one component, and members of one group in several.
    found = components(links)
    placed = materialize(
        members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("g", "n", "rep", F.coalesce("component", "rep").alias("component")), "placed"
    )
    spread = shared.join(placed.groupBy("g", "n").agg(F.min("component").alias("c0"), F.max("component").alias("c1")), ["g", "n"])
    held = F.count(F.lit(1)).over(Window.partitionBy("element"))
    open_ = _enough(_by_two(_enough(_by_two(spread, "c0", "c1")).withColumn("held", held), "c0", "c1"))
    # How many elements are left from this one on: the ones that fewest groups hold come first.
    falling = Window.partitionBy("g", "n").orderBy(F.desc("held"), F.desc("element"))
    open_ = open_.withColumn("left", F.row_number().over(falling)).withColumn("before", F.lead("element").over(falling))
    rest = _by_two(open_.where(F.col("left") >= _needed(F.col("n"))), "c0", "c1")
    rest = materialize(rest.select("element", "before", "g", "n", "left", "c0", "c1"), "rest")
    near = _meetings(rest).distinct()
    across = near.join(placed, ["g", "n"]).join(_renamed(placed), ["g0", "n0"]).where("component <> component0").select(*_ordered(F.col("rep"), F.col("rep0")))
    p, q = placed.alias("p"), placed.alias("q")
    inside = p.join(q, (F.col("p.g") == F.col("q.g")) & (F.col("p.n") == F.col("q.n")) & (F.col("p.component") < F.col("q.component"))).select(
        *_ordered(F.col("p.rep"), F.col("q.rep"))
    )
    more = _verified(across.unionByName(inside).distinct().join(links, ["a", "b"], "left_anti"), texts, "rest")
    # Equal sets, and rows of one id, are linked without being compared.
    same = usable.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = components(links.unionByName(more).unionByName(same), "documents")
    return described.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with their columns (NULL ids stay)."""
    drop = similar_documents(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == drop["__copy"], "left_anti")
