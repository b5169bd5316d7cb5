"""Packing token sequences by non-negative least squares.

Documents are tokenized once; only piece lengths and checksums are kept. Pieces of a whole
window stand alone. For the others a histogram of lengths (a few hundred bins, whatever the
data) goes to the driver: shallow combinations of bins that fill a window are enumerated,
their repeat counts are the non-negative least-squares solution against the histogram,
rounded down, and the rest is packed greedily, still as (combination, repeat count). Each
piece then finds its place from its rank within its bin.

Where the order of the documents matters (after a mix), they are cut in that order into runs
of ``RUN_ROWS``; each run is planned for itself, and sequences are numbered run by run, within
a run by their first piece.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import materialize, ranked

WINDOW = 2048
END_ID = 1
# Lengths are rounded up to multiples of this in the plan: at most 7 tokens of padding a piece.
STEP = 8
# Words whose ids a worker remembers (some 150 bytes each).
MEMORY = 700_000
# Documents of a run, where the order matters.
RUN_ROWS = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of the byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    A blank between two other characters always starts a token, so a text may be cut there
    and each word looked up in a bounded memory. Unknown words, and texts with blanks in a
    row or a special token's name, go to the libraries, which give the same ids.
    """

    _known: dict[str, Encoder] = {}

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json, self._full, self._words = public_tokenizers.path(f"{name}.json"), None, {}

    @classmethod
    def get(cls, name: str) -> Encoder:
        if name not in cls._known:
            cls._known[name] = cls(name)
        return cls._known[name]

    def _slow(self, text: str) -> bytes:
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self._json)
        return np.array(self._full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = np.array(self._bpe.encode_ordinary(word), "<u4").tobytes()
        if len(self._words) < MEMORY and len(word) < 40:
            self._words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self._slow(text)
        if "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace():
            return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()
        words = text.split(" ")
        if any(w[:1].isspace() or w[-1:].isspace() for w in words if not w.isalnum()):
            return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()
        known, word = self._words.get, self._word
        first = self._bpe.encode_ordinary(words[0])
        return np.array(first, "<u4").tobytes() + b"".join([known(w) or word(w) for w in [" " + w for w in words[1:]]])


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k", carried: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of at most ``window`` tokens, with the ``carried`` long columns; only documents longer than that are cut.

    A NULL or empty text has the end id alone. Rows with equal or NULL ids stay separate.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *carried]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.get(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, *more in zip(*(c.to_pylist() for c in batch.columns)):
                ids = (encoder.encode(text) if text else b"") + end
                n = len(ids) // 4
                out += [(doc_id, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n, *more) for s in range(0, n, window)]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(cut, ", ".join([PIECES, *(f"{c} long" for c in carried)]))


def combinations(bins: list[int], total: int) -> list[tuple[int, ...]]:
    """Multisets of at most three of ``bins`` that add up to ``total``."""
    present = set(bins)
    out = [(total,)] if total in present else []
    out += [(a, total - a) for a in bins if 2 * a <= total and total - a in present]
    out += [(a, b, total - a - b) for a, b in itertools.combinations_with_replacement(bins, 2) if total - a - b >= b and total - a - b in present]
    return out


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |a x - h| with x >= 0, by the active-set method on the normal equations."""
    gram, target = a.T @ a, a.T @ h
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = target - gram @ x
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(h.max())):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.solve(gram[np.ix_(at, at)] + 1e-10 * np.eye(len(at)), target[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] += step * (z - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
    return x


def plan(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of one sequence, how often) so that every piece of the histogram is used exactly once."""
    left = {b: n for b, n in histogram.items() if n}
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((parts, times))
            for b in parts:
                left[b] -= times

    def most(parts: tuple[int, ...]) -> int:
        return min(left[b] // parts.count(b) for b in set(parts))

    use((units,), left.get(units, 0))
    bins = sorted(b for b in left if left[b])
    shapes = combinations(bins, units) if bins else []
    if shapes:
        row = {b: i for i, b in enumerate(bins)}
        a = np.zeros((len(bins), len(shapes)))
        for j, parts in enumerate(shapes):
            for b in parts:
                a[row[b], j] += 1
        counts = np.array([left[b] for b in bins], float)
        repeats = nnls(a, counts / counts.max()) * counts.max()
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] < 1:
                break
            use(shapes[j], min(int(repeats[j] + 1e-6), most(shapes[j])))
    while bins := sorted((b for b in left if left[b] > 0), reverse=True):
        free, parts = units, []
        for b in bins:
            n = min(free // b, left[b])
            parts += [b] * n
            free -= n * b
        use(tuple(parts), most(tuple(parts)))
    return out


def pack(pieces_: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``window`` tokens."""
    units = window // step
    cut = pieces_.withColumn("__bin", F.ceil(F.col("length") / step).cast("int"))
    histogram = {r["__bin"]: r["n"] for r in cut.groupBy("__bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `units` rows
    first = np.zeros(units + 2, np.int64)  # global rank of a bin's first piece
    np.cumsum([histogram.get(b, 0) for b in range(units + 1)], out=first[1:])
    used, rows, base = dict.fromkeys(histogram, 0), [], 0
    for parts, times in plan(histogram, units):
        for slot, b in enumerate(parts):
            rows.append((int(first[b]) + used[b], base, slot))
            used[b] += times
        base += times
    rows.sort()
    starts, bases, slots = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 3
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = first[batch.column("__bin").to_numpy()] + batch.column("__rank").to_numpy()
            at = np.searchsorted(starts, rank, "right") - 1
            found = [pa.array(bases[at] + rank - starts[at]), pa.array(slots[at])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *found], names=[*names, "sequence_id", "__slot"])

    placed = ranked(cut, ["__bin"], ["doc_id", "start", "ids_crc32"], "__rank").mapInArrow(place, f"{PIECES}, sequence_id long, __slot long")
    before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", F.sum("length").over(before) - F.col("length")).drop("__slot")


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: where its ids are in its document, and where they go.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. NULL and empty
    texts are one piece with the end id; an empty table gives no rows; extra columns are ignored.
    """
    return pack(materialize(pieces(docs, window, end_id, tokenizer), "pieces"), window)


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``position``, from 0 in the order in which the rows lie: by part file, then by row in the file."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":  # not files as they were written
        docs = materialize(docs.select("doc_id", "text"), "ordered")
    rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))
    number = F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1)
    order = Window.orderBy(F.when(number != "", number.cast("long")), "__file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select("__file", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__first"))
    return rows.join(F.broadcast(starts), "__file").select("doc_id", "text", (F.col("__first") + F.col("__row")).alias("position"))


def pack_run(bins: np.ndarray, lengths: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of a run; pieces of a bin are used in their order, sequences are numbered by their first piece."""
    n = len(bins)
    of_bin = {int(b): np.flatnonzero(bins == b) for b in np.unique(bins)}
    used, sequence, base = dict.fromkeys(of_bin, 0), np.zeros(n, np.int64), 0
    for parts, times in plan({b: len(at) for b, at in of_bin.items()}, units):
        for b in parts:
            sequence[of_bin[b][used[b] : used[b] + times]] = base + np.arange(times)
            used[b] += times
        base += times
    first = np.full(base, n, np.int64)
    np.minimum.at(first, sequence, np.arange(n))
    number = np.empty(base, np.int64)
    number[np.argsort(first)] = np.arange(base)
    sequence = number[sequence]
    by = np.argsort(sequence, kind="stable")
    before = np.cumsum(lengths[by]) - lengths[by]
    offset = np.empty(n, np.int64)
    offset[by] = before - before[np.searchsorted(sequence[by], sequence[by])]
    return sequence, offset


def pack_in_order(
    docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k", run_rows: int = RUN_ROWS, step: int = STEP
) -> DataFrame:
    """As ``pack_documents``, with sequences that follow the order in which the rows of ``docs`` lie.

    Every ``run_rows`` documents share no sequence with the ones before and after them.
    """
    cut = materialize(pieces(positions(docs), window, end_id, tokenizer, ("position",)), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "run"]

    def place(run: pa.Table) -> pa.Table:
        run = run.sort_by([("position", "ascending"), ("start", "ascending")])
        lengths = run.column("length").to_numpy()
        found = pack_run(-(-lengths // step), lengths, window // step)
        return pa.Table.from_arrays([*(run.column(c) for c in names[:5]), *map(pa.array, found), run.column("run")], names=names)

    runs = cut.withColumn("run", F.floor(F.col("position") / run_rows))
    placed = materialize(runs.groupBy("run").applyInArrow(place, f"{PIECES}, sequence_id long, offset long, run long"), "runs")
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    bases = placed.groupBy("run").agg((F.max("sequence_id") + 1).alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(bases, "run").withColumn("sequence_id", F.col("sequence_id") + F.col("base")).select(*names[:-1])
