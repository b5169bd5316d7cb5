"""TF-IDF as a table, and a linear text classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.text import tokens
from tidebook.session import importable, materialize


# Terms whose weights are sent to every task: about 100 MB with ten classes. More of them are joined by a shuffle.
MOST_SENT = 500_000
# Weights (terms times classes) that the driver and every task hold as an array while they are trained: 128 MB. More of them are a table.
MOST_HELD = 16_000_000
# Documents of a block of cells (about a megabyte), and terms of a block of slopes.
BLOCK_DOCS, BLOCK_TERMS = 250, 65_536
# A reader holds a whole row group of such blocks: cut after each 8 MB, looked at after every row.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def _sent(table: DataFrame, terms: int) -> DataFrame:
    return F.broadcast(table) if terms <= MOST_SENT else table


def _clustered_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``term_counts`` with a document's rows together: texts are shuffled once instead of their terms, and sums per document need no other shuffle."""
    return term_counts(docs.select(key, text).repartition(key), key, text)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf). The terms of a text are counted where the row lies; only counts are shuffled."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf_of(counts: DataFrame, n: int, min_df: int = 2) -> DataFrame:
    """(term, idf) of the terms that ``n`` documents with these (document, term) rows have in at least ``min_df`` of them: ln((1 + n) / (1 + df)) + 1."""
    found = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return found.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def fit_idf(docs: DataFrame, key: str, text: str, min_df: int = 2) -> DataFrame:
    """(term, idf) of the terms found in at least ``min_df`` documents. A text's distinct terms are found where the row lies."""
    found = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return idf_of(found, docs.agg(F.count(F.lit(1))).first()[0], min_df)


def weights_of(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) with unit length per document, from (key, term, tf) rows."""
    weighted = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # A document's window holds its distinct terms only.
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / length).alias("weight"))


def tfidf(docs: DataFrame, idf: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight) with unit length per document. No vocabulary passes through the driver."""
    return weights_of(term_counts(docs, key, text), idf, key)


@dataclass
class TextModel:
    """A linear text classifier as a table of ``term, idf, w0, w1, ..`` (one weight per class) and one bias per class."""

    weights: DataFrame
    classes: list
    bias: list[float]
    text: str
    terms: int

    def table(self) -> DataFrame:
        """(term, class, weight)."""
        cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"w{i}").alias("weight")) for i, c in enumerate(self.classes)])
        return self.weights.select("term", F.inline(cells))

    def margins(self, docs: DataFrame, key: str) -> DataFrame:
        """(key, m0, m1, ..) of the documents with a known term: one join and one group-by over their term counts."""
        k = range(len(self.classes))
        found = _clustered_counts(docs, key, self.text).join(_sent(self.weights, self.terms), "term").withColumn("x", F.col("tf") * F.col("idf"))
        sums = found.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"), *[F.sum(F.col("x") * F.col(f"w{i}")).alias(f"m{i}") for i in k])
        return sums.select(key, *[(F.col(f"m{i}") / F.col("len") + F.lit(self.bias[i])).alias(f"m{i}") for i in k])

    def __call__(self, docs: DataFrame, key: str | None = None) -> DataFrame:
        """``docs`` with ``predicted``: the class of the largest margin, the first of equal ones; a text without known terms has the biases alone."""
        if not self.classes:
            return docs.withColumn("predicted", F.lit(None).cast("string"))
        docs, own = _keyed(docs, key)
        k = range(len(self.classes))
        joined = docs.join(self.margins(docs, own).withColumnRenamed(own, "__k"), F.col(own) == F.col("__k"), "left")
        margins = F.array(*[F.coalesce(f"m{i}", F.lit(self.bias[i])) for i in k])
        best = F.get(F.array(*[F.lit(c) for c in self.classes]), (F.array_position(margins, F.array_max(margins)) - 1).cast("int"))
        return joined.withColumn("predicted", best).drop("__k", *[f"m{i}" for i in k], *([] if key else [own]))


def _keyed(docs: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    """Documents with a unique key; without one they are numbered and stored, so that a second reading finds the same numbers."""
    return (docs, key) if key else (materialize(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed"), "__key")


def fit_text_classifier(
    train: DataFrame, text: str, label: str, key: str | None = None, min_df: int = 2, rounds: int = 30, penalty: float = 1e-4, most_classes: int = 100,
) -> TextModel:
    """One-vs-rest linear classifier on TF-IDF vectors, trained by rounds of joins and sums.

    Minimises the mean squared hinge loss + penalty / 2 * |weights|^2 by accelerated gradient
    steps. A text's cells lie together, in blocks of arrays. A round is one pass over them: a task
    has the weights as an array, finds the margins and slopes of its documents, and sums the slopes per
    term; blocks of terms are summed over the tasks and moved in the driver. Terms are numbered
    by their 64-bit hashes, and their strings stay in a table. With more than ``MOST_HELD`` weights (or two terms of equal hash)
    the weights are a table too, and a round is two joins and two sums. Terms are those of ``min_df`` documents.
    ``key`` is unique. Rows with a NULL label are left out, as are texts without known terms.
    """
    known, key = _keyed(train.where(F.col(label).isNotNull()), key)
    classes = [r[0] for r in known.select(label).distinct().orderBy(label).limit(most_classes + 1).collect()]
    if len(classes) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    counted = materialize(_counted(known, text, label, key, classes), "terms")
    total = known.count()
    idf = materialize(idf_of(counted.select(F.explode("terms").alias("term")), total, min_df), "idf")
    terms = idf.count()
    held = _numbered(idf) if 0 < terms * len(classes) <= MOST_HELD else None
    if held is not None:
        weights, bias = _by_arrays(counted, idf, *held, len(classes), rounds, penalty)
    else:
        counts = counted.select(F.col("key").alias(key), F.inline(F.arrays_zip("terms", "tf")).alias("term", "tf"))
        weights, bias = _by_tables(known, counts, idf, terms, label, key, classes, rounds, penalty)
    return TextModel(materialize(weights, "text-model"), classes, bias, text, terms)


def _counted(known: DataFrame, text: str, label: str, key: str, classes: list) -> DataFrame:
    """(key, ys, terms, tf): one row per key with its class numbers (none if it is NULL) and its distinct terms. Texts are shuffled once."""
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1 if classes else F.lit(0)
    docs = known.select(F.col(key).alias("key"), F.col(text).alias("text"), y.alias("y")).repartition("key")
    rows = docs.groupBy("key").agg(F.collect_list("y").alias("ys"), F.collect_list("text").alias("texts"))
    ys = F.when(F.col("key").isNull(), F.array().cast("array<int>")).otherwise(F.col("ys"))
    rows = rows.select("key", ys.alias("ys"), F.flatten(F.transform("texts", tokens)).alias("tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(at, BLOCK_DOCS)
                n = batch.num_rows
                found = batch.column(2).flatten().dictionary_encode()
                words = max(len(found.dictionary), 1)
                sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                cell, tf = np.unique(np.repeat(np.arange(n), sizes) * words + found.indices.to_numpy(), return_counts=True)
                starts = pa.array(np.searchsorted(cell, np.arange(n + 1) * words), pa.int32())
                columns = [pa.ListArray.from_arrays(starts, found.dictionary.take(pa.array(cell % words))), pa.ListArray.from_arrays(starts, pa.array(tf, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "ys", "terms", "tf"])

    importable(known.sparkSession)
    return rows.mapInArrow(count, f"key {rows.schema['key'].dataType.simpleString()}, ys array<int>, terms array<string>, tf array<int>")


def _numbered(idf: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The terms' hashes in order, by which they are numbered, and their idf; None if two terms share one."""
    table = idf.select(F.xxhash64("term").alias("h"), "idf").toArrow()
    hashes, values = (table.column(c).to_numpy() for c in ("h", "idf"))
    order = np.argsort(hashes)
    hashes, values = hashes[order], values[order]
    return None if (hashes[1:] == hashes[:-1]).any() else (hashes, values)


BLOCK = ("ids", "term", "x", "starts", "doc", "y", "times", "rows")
KINDS = (np.int32, np.int32, np.float64, np.int32, np.int32, np.int32, np.int32, np.int32)


def _blocks(counted: DataFrame, hashes: np.ndarray, idf: np.ndarray) -> DataFrame:
    """Blocks of documents: the numbers of their terms (``ids``), then per cell the place of its term there and its weight, and each document's first cell.

    ``doc``, ``y``, ``times``, ``rows``: each class of a document, how often it has the class, and how many classes it has, all counted (all 1 where the key is unique).
    """
    sent = counted.sparkSession.sparkContext.broadcast((hashes, idf))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, idf = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(s, BLOCK_DOCS)
                n = batch.num_rows
                h = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(n), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                some = hashes[at] == h
                at, doc, tf = at[some], doc[some], batch.column(2).flatten().to_numpy(zero_copy_only=False)[some]
                if not len(at):
                    continue
                x = tf * idf[at]
                x = x / np.sqrt(np.bincount(doc, x * x, n))[doc]
                docs, starts = np.unique(doc, return_index=True)
                ids, term = np.unique(at, return_inverse=True)
                sides = []
                ys = batch.column(0).to_pylist()
                for i, d in enumerate(docs.tolist()):
                    sides += [(i, c, ys[d].count(c), len(ys[d])) for c in sorted(set(ys[d]))]
                block = (ids, term, x, starts, *np.array(sides).T)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c, k).tobytes()], pa.binary()) for c, k in zip(block, KINDS)], names=list(BLOCK))

    rows = counted.where(F.size("ys") > 0).select("ys", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"), "tf")
    return rows.mapInArrow(pack, ", ".join(f"{c} binary" for c in BLOCK))


def _by_arrays(counted: DataFrame, idf: DataFrame, hashes: np.ndarray, values: np.ndarray, classes: int, rounds: int, penalty: float) -> tuple[DataFrame, list[float]]:
    spark = counted.sparkSession
    blocks = materialize(_blocks(counted, hashes, values), "cells", **SMALL_GROUPS)
    n = blocks.select("times").mapInArrow(_documents, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    w, u = (np.zeros((len(hashes), classes)) for _ in range(2))
    bias, ahead = np.zeros(classes), np.zeros(classes)
    rate = 1.0 / (4.0 + penalty)  # rows have length 1, with the bias 2
    for t in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast(u)
        push = t / (t + 3.0)
        rest = set(range(0, len(u), BLOCK_TERMS))
        for start, d in chain(_slopes(blocks, sent, ahead, n).toLocalIterator(), [(s, None) for s in rest]):
            if start < 0:
                now = ahead - rate * np.frombuffer(d)
                ahead, bias = now + push * (now - bias), now
            elif start in rest:
                rest.remove(start)
                some = slice(start, start + BLOCK_TERMS)
                slope = np.frombuffer(d).reshape(-1, classes) if d else 0.0
                a = u[some] - rate * (slope + penalty * u[some])
                u[some], w[some] = a + push * (a - w[some]), a
        sent.destroy()
    last = spark.sparkContext.broadcast((hashes, w))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = last.value
        for batch in batches:
            found = w[np.searchsorted(hashes, batch.column(2).to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in found.T]], names=["term", "idf", *[f"w{i}" for i in range(classes)]])

    table = idf.select("term", "idf", F.xxhash64("term")).mapInArrow(look, ", ".join(["term string, idf double", *[f"w{i} double" for i in range(classes)]]))
    return table, bias.tolist()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = sum(int(np.frombuffer(times, np.int32).sum()) for times in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def _slopes(blocks: DataFrame, sent, ahead: np.ndarray, n: int) -> DataFrame:
    """(start, d): the sums of the slopes of the terms from number ``start``, and at start -1 of the biases, for the weights that are ``sent``."""
    classes, terms = len(ahead), len(sent.value)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, total, d = sent.value, np.zeros(classes), None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, term, x, starts, doc, y, times, rows = (np.frombuffer(c[i].as_buffer(), k) for c, k in zip(batch.columns, KINDS))
                own = u[ids]
                margin = np.empty((len(starts), classes))
                for c in range(classes):
                    margin[:, c] = np.add.reduceat(x * own[:, c][term], starts)
                side = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
                g = -2.0 * side * np.maximum(0.0, 1.0 - side * (times[:, None] * margin[doc] + ahead)) / n
                total += g.sum(0)
                cells = np.diff(np.r_[starts, len(x)])
                d = np.zeros(u.shape) if d is None else d
                for c in range(classes):
                    slope = np.bincount(doc, rows * g[:, c], len(starts))
                    if slope.any():
                        d[ids, c] += np.bincount(term, x * np.repeat(slope, cells), len(ids))
        if d is not None:
            yield block(-1, np.zeros(1), total)
            for start in range(0, len(d), BLOCK_TERMS):
                some = np.flatnonzero(d[start : start + BLOCK_TERMS].any(1))
                yield block(start, some, d[start + some])

    def block(start: int, at: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([d.tobytes()], pa.binary())], names=["start", "at", "d"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for start, at, d in zip(*(c.to_pylist() for c in batch.columns)):
                if start != last:
                    if last is not None:
                        yield whole(last, total)
                    last, total = start, np.zeros((min(BLOCK_TERMS, terms - start) if start >= 0 else 1, classes))
                total[np.frombuffer(at, np.int32)] += np.frombuffer(d).reshape(-1, classes)
        if last is not None:
            yield whole(last, total)

    def whole(start: int, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([d.tobytes()], pa.binary())], names=["start", "d"])

    parts = blocks.mapInArrow(sums, "start long, at binary, d binary")
    return parts.repartition("start").sortWithinPartitions("start").mapInArrow(add, "start long, d binary")


def _by_tables(known: DataFrame, counts: DataFrame, idf: DataFrame, terms: int, label: str, key: str, classes: list, rounds: int, penalty: float) -> tuple[DataFrame, list[float]]:
    """The weights as a table: a round joins the (document, term, weight) table with them, sums margins per document, joins the documents' slopes back and sums them per term."""
    k = range(len(classes))
    weighted = counts.join(_sent(idf, terms), "term").withColumn("x", F.col("tf") * F.col("idf"))
    length = weighted.groupBy(F.col(key).alias("__k")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    labels = known.select(F.col(key).alias("__l"), F.col(label).alias("y")).join(length, F.col("__l") == F.col("__k")).drop("__l")
    cells = weighted.join(labels, F.col(key) == F.col("__k")).select("__k", "y", "term", (F.col("x") / F.col("len")).alias("x"))
    # Clustered by document: margins are mostly summed before they are shuffled.
    cells = materialize(cells if terms <= MOST_SENT else cells.repartition("__k"), "cells")
    n = labels.count()
    weights = idf.select("term", *[F.lit(0.0).alias(f"w{i}") for i in k], *[F.lit(0.0).alias(f"u{i}") for i in k])
    bias, ahead = [0.0] * len(classes), [0.0] * len(classes)
    rate = 1.0 / (4.0 + penalty)  # rows have length 1, with the bias 2
    for t in range(rounds if n else 0):
        margins = cells.join(_sent(weights.select("term", *[f"u{i}" for i in k]), terms), "term").groupBy("__k", "y").agg(*[F.sum(F.col("x") * F.col(f"u{i}")).alias(f"m{i}") for i in k])
        slopes = []
        for i in k:
            side = F.when(F.col("y") == F.lit(classes[i]), 1.0).otherwise(-1.0)
            slopes.append((-2.0 * side * F.greatest(F.lit(0.0), 1.0 - side * (F.col(f"m{i}") + F.lit(ahead[i]))) / n).alias(f"g{i}"))
        slopes = materialize(margins.select("__k", *slopes), "slopes")
        steps = cells.select("__k", "term", "x").join(slopes, "__k").groupBy("term").agg(*[F.sum(F.col("x") * F.col(f"g{i}")).alias(f"d{i}") for i in k])
        push = t / (t + 3.0)
        moved = weights.join(steps, "term")
        after = [F.col(f"u{i}") - rate * (F.col(f"d{i}") + penalty * F.col(f"u{i}")) for i in k]
        weights = materialize(moved.select("term", *[a.alias(f"w{i}") for i, a in enumerate(after)], *[(a + push * (a - F.col(f"w{i}"))).alias(f"u{i}") for i, a in enumerate(after)]), "weights")
        totals = slopes.agg(*[F.sum(f"g{i}") for i in k]).first()
        now = [ahead[i] - rate * totals[i] for i in k]
        bias, ahead = now, [now[i] + push * (now[i] - bias[i]) for i in k]
    return idf.join(weights, "term").select("term", "idf", *[f"w{i}" for i in k]), bias
