"""Phrase collocations from one count: the longest windows, and ROLLUP for every shorter phrase.

Each word starts one window of the longest length, padded where its piece ends, so phrases of all
lengths are prefixes of windows: a phrase's count is the sum over the windows it begins. Only
windows are counted. A task counts those of many texts before anything is shuffled, with the
words as numbers and the lead columns as shifted arrays; a word that is too rare to be in any
phrase, by a bit table of fixed size, pads a window like the end of a piece. Windows then meet by
language and their first two words. There a last word is replaced by padding wherever the prefix
that it ends is too rare to matter, which keeps the sums of all shorter prefixes, and Spark's
ROLLUP over what is left sums the prefixes of every length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import materialize

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
NO_LANG = "und"
# Words whose windows a task counts at a time (some 60 bytes each), and rows of an Arrow batch.
HOLD, ROWS = 2_000_000, 50_000
# Bytes of a text that are split at a time.
STRETCH = 1 << 23
BREAK, RARE = b"\n", b"\r"
# Places of the frequent words' bits: a power of two.
BITS = 1 << 26
# A-Z to a-z, the signs that end a piece to a line end, tabs to blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text in order, some megabytes at a time, cut between words. Empty entries may occur."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        while end < len(text) and text[end] not in b" \t.,;:!?\n\x0b\x0c\r":
            end += 1
        yield text[at:end].translate(FOLD).replace(BREAK, b" \n ").split(b" ")
        at = end


class Counter:
    """Windows of the words that are held; ``flush`` counts them.

    With the ``known`` bits of frequent words, a window is padded from its first other word on,
    and begins with ``RARE`` if that is its first.
    """

    def __init__(self, longest: int, known: np.ndarray | None = None):
        self.longest, self.known = longest, known
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        for i, word in enumerate((BREAK, b"", RARE)):
            self.number[word] = i
        self.langs: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        ids = ids[ids != 1]
        self.ids.append(ids)
        self.lang.append(np.full(len(ids), self.langs.setdefault(lang, len(self.langs)), np.int32))
        self.held += len(ids)

    def end(self) -> None:
        """Nothing goes on from here."""
        self.ids.append(np.zeros(1, np.int32))
        self.lang.append(np.zeros(1, np.int32))

    def _frequent(self, lang: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each place has a word that may be frequent in its language."""
        if self.known is None:
            return ids > 0
        words, keys, size = list(self.number), [name.encode() + BREAK for name in self.langs], len(self.number)
        out = ids > 0
        found, back = np.unique(lang[out].astype(np.int64) * size + ids[out], return_inverse=True)
        at = np.fromiter((xxhash.xxh64_intdigest(keys[p // size] + words[p % size], seed=42) % BITS for p in found.tolist()), np.int64, len(found))
        out[out] = (self.known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)[back]
        return out

    def count(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Language and word columns of all places; the distinct windows' heads (all but the last word), a place of each, and their counts."""
        lang, first = np.concatenate(self.lang), np.concatenate(self.ids)
        self.lang, self.ids = [], []
        fine = self._frequent(lang, first)
        columns, goes_on = [lang, np.where((first > 0) & ~fine, 2, first)], fine
        follows = np.where(fine, first, 0)
        for lead in range(1, self.longest):
            ahead = np.zeros_like(first)
            ahead[: max(0, len(first) - lead)] = follows[lead:]
            ahead[~goes_on] = 0
            columns.append(ahead)
            goes_on = ahead > 0
        columns = [c[first > 0] for c in columns]
        size = len(self.number)
        code, bound = columns[0].astype(np.int64), len(self.langs)
        for c in columns[1:]:
            if bound * size >= 2**63:
                code = np.unique(code, return_inverse=True)[1]
                bound = len(code)
            code, bound = code * size + c, bound * size
        code, at, times = np.unique(code, return_index=True, return_counts=True)
        return columns, code // size, at, times

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        columns, head, at, times = self.count()
        words = [b"" if w == BREAK else w for w in self.number]
        texts, langs = pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(self.langs), pa.string())
        if self.longest == 1:
            for start in range(0, len(at), ROWS):
                part = at[start : start + ROWS]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(columns[0][part])), texts.take(pa.array(columns[1][part])), pa.array(times[start : start + ROWS].astype(np.int64))], names=["lang", "w1", "c"])
            self.clear()
            return
        # Windows that differ in their last word only travel as one row; a count above one follows its word.
        heads = np.flatnonzero(np.diff(head, prepend=-1)).astype(np.int64)
        names = ["head", *_names(self.longest)[2:-1], "ends"]
        for start in range(0, len(heads), ROWS):
            own = heads[start : start + ROWS]
            stop = heads[start + ROWS] if start + ROWS < len(heads) else len(at)
            offsets = pa.array(np.append(own, stop) - own[0], pa.int32())
            first, ends, n = at[own], texts.take(pa.array(columns[-1][at[own[0] : stop]])), pa.array(times[own[0] : stop])
            ends = pc.if_else(pc.greater(n, 1), pc.binary_join_element_wise(ends, n.cast(pa.string()), "\t"), ends)
            opening = [langs.take(pa.array(columns[0][first])), *[texts.take(pa.array(c[first])) for c in columns[1 : min(3, self.longest)]]]
            between = [texts.take(pa.array(c[first])) for c in columns[3:-1]]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*opening, "\n"), *between, pc.binary_join(pa.ListArray.from_arrays(offsets, ends), " ")], names=names)
        self.clear()


def _names(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


def _count_in_tasks(docs: DataFrame, longest: int, known: Broadcast | None, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(longest, None if known is None else np.frombuffer(known.value, np.uint8))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for words in words_of(text or b""):
                        held.add(lang, words)
                    held.end()
                    if held.held >= HOLD:
                        yield from held.flush()
        yield from held.flush()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def frequent_words(docs: DataFrame, least: int) -> bytes:
    """Bits of a hash of language and word, set for every word that occurs ``least`` times: 8 MB, whatever the data.

    A clear bit proves that a word is rarer, and with it every phrase that has it. With very many
    words more bits are set and fewer windows are cut short; counts stay the same.
    """
    counts = _count_in_tasks(docs, 1, None, "lang string, w1 string, c long").groupBy("lang", "w1").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    place = F.pmod(F.xxhash64(F.concat_ws("\n", "lang", "w1")), F.lit(BITS)) + 1
    bits = counts.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(BITS // 8)
    for bucket, part in bits.collect():  # at most BITS / 32768 rows of 4 KB
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] = part
    return bytes(out)


def windows(docs: DataFrame, longest: int = LONGEST, least: int = 1) -> DataFrame:
    """Windows of ``longest`` words, padded with empty words, counted within a task.

    A row has, on lines of ``head``, the language and the first two words (one of two), further words but the last in columns,
    and in ``ends`` the last words, blank-separated, a count above one behind its word and a tab.
    Windows are padded from words that occur fewer than ``least`` times.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, least)) if least > 1 else None
    return _count_in_tasks(docs, longest, known, ", ".join(f"{n} string" for n in ("head", *_names(longest)[2:-1], "ends")))


def folded(counted: DataFrame, longest: int, least: int) -> DataFrame:
    """Windows whose words are padding from where their prefix occurs fewer than ``least`` times.

    The sum over any prefix that occurs ``least`` times stays as it is. Rows meet once, by
    language and first two words; sums of all longer prefixes are local.
    """
    tails, entry = _names(longest)[2:], F.col("entry")
    rows = counted.repartition("head") if tails else counted
    word = F.substring_index(entry, "\t", 1)
    times = F.when(F.contains(entry, F.lit("\t")), F.substring_index(entry, "\t", -1).cast("long")).otherwise(F.lit(1).cast("long"))
    rows = rows.select("head", *tails[:-1], F.explode(F.split("ends", " ")).alias("entry"))
    if tails:
        rows = rows.select("head", *tails[:-1], word.alias(tails[-1]), times.alias("c"))
    else:
        rows = rows.select(F.concat("head", F.lit("\n"), word).alias("head"), times.alias("c")).repartition("head")
    rows = rows.groupBy("head", *tails).agg(F.sum("c").alias("c"))
    rare = F.col("c") < least
    for j in range(len(tails) - 1, -1, -1):
        rows = rows.withColumn(tails[j], F.when(rare, "").otherwise(F.col(tails[j])))
        # ``all`` of a prefix counts the longer windows that begin with it; their own ``c`` stays with them.
        zero, longer, after = F.lit(0).cast("long"), F.col(tails[j]) != "", tails[j:]
        own = F.struct(*after, "c", F.when(longer, zero).otherwise(F.col("c")).alias("all"))
        prefix = F.struct(*[F.lit("").alias(n) for n in after], zero.alias("c"), F.col("c").alias("all"))
        rows = rows.select("head", *tails[:j], F.inline(F.when(longer, F.array(own, prefix)).otherwise(F.array(own))))
        rows = rows.groupBy("head", *tails).agg(F.sum("c").alias("c"), F.sum("all").alias("all"))
        rare = (F.col(tails[j]) == "") & (F.col("all") < least)
    second = F.substring_index("head", "\n", -1)
    cut = F.left("head", F.length("head") - F.length(second))
    rows = rows.withColumn("head", F.when(rare, cut).otherwise(F.col("head"))).groupBy("head", *tails).agg(F.sum("c").alias("c"))
    pair = F.substring_index("head", "\n", -2)
    lang = F.left("head", F.length("head") - F.length(pair) - 1)
    return rows.select(lang.alias("lang"), F.substring_index(pair, "\n", 1).alias("w1"), second.alias("w2"), *tails, "c")


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of up to ``longest`` words that occurs ``least`` times; 0 words: all words of the language."""
    names = _names(longest)
    summed = folded(windows(docs, longest, least), longest, least).rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("id"))
    # Columns that are summed over are ones in the grouping id, from the right.
    summed = summed.withColumn("words", F.lit(longest) - F.when(F.col("id") > 0, F.length(F.bin("id"))).otherwise(0)).where("words >= 0")
    whole = F.coalesce(F.get(F.array(*names), F.col("words") - 1) != "", F.lit(True))
    whole = whole & ~F.col("w1").eqNullSafe(RARE.decode())
    return summed.where(whole & ((F.col("words") == 0) | (F.col("f") >= least))).select("lang", "words", F.concat_ws(" ", *names).alias("phrase"), "f")


def score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (l r)) of counts up to 10 ** 15, exactly."""
    return F.expr(f"(decimal(1000000) * CAST({a} AS decimal(19,0)) * CAST({a} AS decimal(19,0))) div (CAST({left} AS decimal(19,0)) * CAST({right} AS decimal(19,0)))")


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("parts", first, count), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score, with their counts.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at blanks and tabs. A
    phrase of 2 to ``longest`` words that occurs ``least`` times is cut where
    floor(1,000,000 a a / (l r)) is least, at the first such place; a, l and r are the counts of
    the phrase and of its two parts, n those of all words. It goes if a longer phrase that holds
    it occurs at least ``share`` per cent as often. Order: score and a descending, phrase by bytes.

    A NULL text counts as empty, a NULL language as ``und``; rows that repeat count each time; a
    language without such phrases, and an empty table, give no rows. Other columns are not read.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    counts = materialize(phrase_counts(docs, longest, least), "phrases")
    parts = counts.where("words > 0").select("lang", "phrase", "f")
    found = counts.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    best = cuts.withColumn("score", score("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every shorter phrase inside a candidate, with the most frequent candidate that holds it.
    held = found.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    held = held.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    held = held.select("lang", _part(F.col("first"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
