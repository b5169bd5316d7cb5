"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

Lines are paragraphs; long ones count as several, so that a text without line breaks has parts
too. A piece ends with a word whose last character is one of a fixed quarter of all, or after
``MOST_WORDS`` words: what follows an inserted or deleted word is cut as before. Each distinct digest is added to three cells (count,
xor of digests, xor of check values). The tables of two versions subtract cell by cell, and
peeling cells that hold a single digest recovers the digests that only one version has. Where
peeling gets stuck, both tables are built again at twice the size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_WORDS = 16
CELLS = 12  # cells of the stored fingerprint: decodes some eight differences
HASHES = 3

# A fixed quarter of the characters of the basic plane, by a hash of the code point.
_END = re.escape("".join(c for c in map(chr, range(33, 0xD800)) if (ord(c) * 0x9E3779B1 >> 20) & 3 == 0 and not c.isspace()))
_PIECE = re.compile(rf"(?:\S++[^\S\n]++){{0,{MOST_WORDS - 1}}}?\S++(?<=[{_END}])|\S++(?:[^\S\n]++\S++){{0,{MOST_WORDS - 1}}}")
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def digests(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit digests of the paragraph pieces of a text."""
    found = {xxhash.xxh3_64_intdigest(p) for p in _PIECE.findall(text or "")}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (x ^ (x >> np.uint64(31))) * by
    return h ^ (h >> np.uint64(29))


def _places(x: np.ndarray, cells: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The cell of each digest in each of the three parts of a table; a table's hashes depend on its size."""
    part = (cells // HASHES).astype(np.uint64)
    salted = x ^ (cells.astype(np.uint64) * _M[3])
    return [first + k * (cells // HASHES) + (_mixed(salted, _M[k]) % part).astype(np.int64) for k in range(HASHES)]


def _check(x: np.ndarray) -> np.ndarray:
    return _mixed(x, _M[3])


class Tables:
    """Many lookup tables side by side; ``owner`` says to which table each digest goes."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.first = np.concatenate([[0], np.cumsum(cells)])
        n = int(self.first[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, owner: np.ndarray, x: np.ndarray, sign: np.ndarray | int) -> None:
        check = _check(x)
        for at in _places(x, self.cells[owner], self.first[owner]):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, x)
            np.bitwise_xor.at(self.checks, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(decoded?, digests only in the added, only in the subtracted) per table."""
        owner_of = np.repeat(np.arange(len(self.cells)), self.cells)
        plus, minus = np.zeros(len(self.cells), np.int64), np.zeros(len(self.cells), np.int64)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (_check(self.keys[look]) == self.checks[look])]
            if not len(pure):
                break
            x, owner, sign = self.keys[pure], owner_of[pure], self.count[pure]
            _, one = np.unique(np.stack([owner.astype(np.uint64), x], 1), axis=0, return_index=True) if len(pure) > 1 else (None, np.array([0]))
            x, owner, sign = x[one], owner[one], sign[one]
            plus += np.bincount(owner[sign > 0], minlength=len(plus))
            minus += np.bincount(owner[sign < 0], minlength=len(minus))
            self.add(owner, x, -sign)
            look = np.unique(np.concatenate(_places(x, self.cells[owner], self.first[owner])))
        stuck = np.zeros(len(self.cells), bool)
        stuck[owner_of[(self.count != 0) | (self.keys != 0)]] = True
        return ~stuck, plus, minus


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """How many digests only ``a[i]`` and only ``b[i]`` has, by peeling; stuck pairs are retried at twice the size."""
    plus, minus = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    todo, size = np.arange(len(a)), np.full(len(a), cells)
    while len(todo):
        tables = Tables(size)
        for sets, sign in ((a, 1), (b, -1)):
            owner, x = _flat([sets[i] for i in todo])
            tables.add(owner, x, sign)
        done, p, m = tables.peel()
        plus[todo[done]], minus[todo[done]] = p[done], m[done]
        todo, size = todo[~done], size[~done] * 2
    return plus, minus


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared digests of all digests, 0 to 1; two texts without digests are alike."""
    plus, minus = differences(a, b)
    size = np.array([len(s) for s in a])
    union = size + minus
    return np.where(union == 0, 1.0, (size - plus) / np.maximum(union, 1))


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """Each table of ``cells`` cells as text: counts, digests and 32-bit checks, base 64."""
    tables = Tables(np.full(len(sets), cells))
    owner, x = _flat(sets)
    tables.add(owner, x, 1)
    low = (tables.checks & np.uint64(2**32 - 1)).astype("<u4")
    counts, keys = tables.count.astype("<i4"), tables.keys.astype("<u8")
    parts = [slice(i * cells, (i + 1) * cells) for i in range(len(sets))]
    return [base64.b64encode(counts[p].tobytes() + keys[p].tobytes() + low[p].tobytes()).decode() for p in parts]


def with_next(docs: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """doc_id, text and the next row's text in (doc_id, text) order, the first after the last.

    Rows are dealt into ranges of ids; the first text of each range is also given to the range
    before it. Ranges come from a sketch of the ids, so their number follows the row count.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    if n == 0:
        return rows.withColumn("next", F.col("text"))
    # At most 10,000 cuts go through the driver, whatever the data.
    parts = min(10_000, max(1, n // rows_per_part, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64)) if parts > 1 else np.zeros(0, np.int64)
    # Ids equal to a cut go to the range that the cut begins; NULL ids are first of all. Cuts
    # are looked up in two steps, first among every hundredth one.
    chunks = [[int(c) for c in cuts[i : i + 100]] for i in range(0, len(cuts), 100)]

    def passed(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>")

    chunk = passed(longs([c[0] for c in chunks]))
    inside = passed(F.get(F.array(*[longs(c) for c in chunks]), F.greatest(chunk - 1, F.lit(0)))) if chunks else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(chunk * 100 + inside)
    dealt = rows.withColumn("part", part.cast("int"))
    ids = dealt.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    ids = ids.select("part", F.when(F.col("nulls") == 0, F.col("doc_id")).alias("first_id"))  # NULL sorts first
    order = Window.orderBy("part")  # one row per range
    lead = ids.select("first_id", F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    heads = rows.join(F.broadcast(lead), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("to").agg(F.min("text").alias("text"))
    both = dealt.withColumn("extra", F.lit(0)).unionByName(heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("part"), F.lit(1).alias("extra")))
    window = Window.partitionBy("part").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next", F.lead("text").over(window)).where("extra = 0").select("doc_id", "text", "next")


def describe(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has the last floor(n / 2) code points replaced by the first as many of the
    next row's text (by doc_id, then text; NULL ids first; the first row follows the last). A
    NULL text counts as empty; a lone row is its own next. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the numbers of
    digests only in the text (``removed``) or only in the edited text (``added``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]
                a, b, c = ([digests(t) for t in x] for x in (texts, edited, following))
                plus, minus = differences(a, b)
                size = np.array([len(s) for s in a])
                near = np.where(size + minus == 0, 1.0, (size - plus) / np.maximum(size + minus, 1))
                sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(fingerprints(a)), pa.array(fingerprints(b)),
                     pa.array(near), pa.array(likeness(a, c)), pa.array(plus), pa.array(minus)],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "removed", "added"],
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, removed long, added long"
    return with_next(docs).mapInArrow(run, schema)
