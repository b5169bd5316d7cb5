"""Near copies among vectors, by a pivot-permutation index.

A vector is described by the ordered list of its nearest reference points (pivots). Inverted
lists hold, per pivot, the vectors that name it; two vectors of a list are candidates when
they share at least ``SHARED`` pivots, and are verified by their cosine. A pair is counted in
the list of the smallest pivot that both name, so no pair is ever written down: a list yields
link counts and, per connected part, one edge for each vector.

Lists are cut into blocks, and pairs of blocks are separate groups of bounded size, so a
pivot that a third of all vectors name is spread over many tasks. The number of pivots grows
with the square root of the row count, which keeps lists short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import materialize
from tidebook.llm.components import components

COSINE = 0.9
NEAREST = 8  # pivots that describe a vector
SHARED = 2  # pivots that candidates share
PIVOTS_PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 4, 64, 8192
BLOCK = 1024  # vectors of a list compared with as many others in one group


def _unit(values: list[list[float] | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of usable vectors, the vectors scaled to length 1); the first usable length counts."""
    found, rows, size = [], [], None
    for i, v in enumerate(values):
        if v is None or not len(v) or any(c is None for c in v):
            continue
        x = np.asarray(v, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0 or (size is not None and len(x) != size):
            continue
        size = len(x)
        x = x / top
        found.append(x / math.sqrt(float(x @ x)))
        rows.append(i)
    return np.array(rows, np.int64), np.array(found).reshape(len(rows), size or 0)


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    ok = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(column, lambda c: c != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _lists(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                _, x = _unit(batch.column(2).to_pylist())
                nearest = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(nearest), pa.list_(pa.int32()))], names=["rep", "copies", "v", "near"])

    return classes.mapInArrow(describe, "rep long, copies long, v array<float>, near array<int>")


def _compare(table: pa.Table) -> pa.Table:
    """Links between the two blocks of one group: per vector the number of linked vectors and its part's smallest id."""
    columns = {c: table.column(c).to_numpy() for c in ("rep", "copies", "block", "i", "j", "pivot")}
    near, (_, x) = np.array(table.column("near").to_pylist(), np.int64), _unit(table.column("v").to_pylist())
    i, j, pivot, rep, copies = columns["i"][0], columns["j"][0], columns["pivot"][0], columns["rep"], columns["copies"]
    left, right = np.flatnonzero(columns["block"] == i), np.flatnonzero(columns["block"] == j)
    a, b = np.nonzero(x[left] @ x[right].T >= COSINE)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    keep = np.zeros(len(a), bool)
    for s in range(0, len(a), 100_000):
        p, q = near[a[s : s + 100_000]], near[b[s : s + 100_000]]
        both = (p[:, :, None] == q[:, None, :]).any(2)
        keep[s : s + 100_000] = (both.sum(1) >= SHARED) & (np.where(both, p, np.iinfo(np.int64).max).min(1) == pivot)
    a, b = a[keep], b[keep]
    links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
    part = rep.copy()
    while True:
        low = np.minimum(part[a], part[b])
        before = part.copy()
        np.minimum.at(part, a, low)
        np.minimum.at(part, b, low)
        if (part == before).all():
            break
    own = links > 0
    return pa.table({"rep": rep[own], "links": links[own].astype(np.int64), "root": part[own]})


def near_copies(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept (it is the smallest of its component).

    Vectors that are NULL, empty, zero or hold NULL or non-finite parts link with nothing, nor
    do vectors of another length than most others. Equal vectors are one class: they are linked
    without being compared. A row with a NULL id takes no part and is kept, with a NULL
    component. An empty table gives no rows; extra columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<float>").alias("v"))
    usable = _usable(rows, "v")
    sizes = usable.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usable = usable.where(F.size("v") == sizes["d"])
    n = sizes["n"]
    classes = materialize(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "v"), "classes")
    # A bounded sample: the classes whose ids hash lowest.
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(PIVOTS_PER_ROOT * math.sqrt(n))))
    _, pivots = _unit([r["v"] for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(wanted).collect()])
    lists = materialize(_lists(classes, pivots), "lists").select("rep", "copies", "v", "near", F.explode("near").alias("pivot"))
    blocks = lists.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where(F.col("blocks") > 0)
    placed = lists.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))  # at most MAX_PIVOTS rows
    partner = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = partner.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "copies", "v", "near", "block")
    found = materialize(pairs.groupBy("pivot", "i", "j").applyInArrow(_compare, "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # Rows of one class share its links; the other rows of the class are linked too.
    same = usable.join(classes, "v").select("vec_id", "rep", "copies")
    same = materialize(same.join(counts, "rep", "left").select("vec_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "counts")
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(same.select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    linked = same.join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    useless = rows.exceptAll(usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(useless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
