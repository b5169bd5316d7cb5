"""Decision trees and forests, grown level by level from one histogram per level.

A level of all trees is one aggregation: weighted class counts by tree, node, feature and bin. The
best cut of each node is found from running sums over the bins, where a tree's counts meet; only the
chosen cuts (one row per node) reach the driver, and go back as arrays that route every
row of the next level. Samples come from a hash of tree and row key, so a task that runs again
draws the same ones. Rows are routed and counted by NumPy over Arrow batches, tree by tree:
150 trees on a million rows are 150 million steps a level, too many for a row of an exploded table each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.session import importable, materialize

# Trees are complete binary heaps in the routing arrays: 2 ** depth numbers per tree.
DEEPEST = 14
MOST_CLASSES = 100
# Counts of one pass over the rows that a task holds: 100 MB. Open nodes with more are counted in several passes.
MOST_CELLS = 12_500_000
WORD = 1 << 32
ARRAYS = ("__features", "__cuts", "__ends")
NODES = "tree int, node int, feature string, cut double, n long, counts array<long>"


def poisson_bounds(rate: float = 1.0, most: int = 12) -> list[str]:
    """Hex words below which a hashed word gives a weight of at most 0, 1, 2, ..: the distribution function of a Poisson number."""
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(most):
        total += term
        bound = min(WORD, math.floor(total * WORD))
        if bound >= WORD:
            break
        out.append(f"{bound:08x}")
        term *= rate / (k + 1)
    return out


def sample_weight(seed: int, tree: Column, key: Column) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, from a hash."""
    word = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), tree.cast("string"), key.cast("string"))), 1, 8)
    bounds = F.array(*[F.lit(b) for b in poisson_bounds()])
    return F.get(F.transform(F.array(word), lambda w: F.size(F.filter(bounds, lambda b: b <= w))), F.lit(0))


@dataclass
class Forest:
    """Grown trees. A node's children are 2 node (value <= cut) and 2 node + 1; leaves have no feature."""

    features: list[str]
    classes: list
    trees: int
    depth: int
    key: str | None
    seed: int
    nodes: list[tuple] = field(default_factory=list)  # (tree, node, feature, cut, n, counts)

    def table(self, df: DataFrame) -> DataFrame:
        """One row per node: tree, node, feature, cut, n and the class counts, in the order of ``classes``."""
        return df.sparkSession.createDataFrame(self.nodes, NODES)

    def votes(self, df: DataFrame, sampled: bool | None = None) -> DataFrame:
        """(.., votes): how many trees say each class. ``sampled`` False: only trees that did not draw the row."""
        size = 1 << (self.depth + 1)
        features, cuts, ends = ([[d] * size for _ in range(self.trees)] for d in (-1, 0.0, 0))
        for t, node, feature, cut, _, counts in self.nodes:
            ends[t][node] = max(range(len(counts)), key=lambda c: (counts[c], -c))
            if feature is not None:
                features[t][node], cuts[t][node] = self.features.index(feature), cut
        values = F.array(*[F.col(f).cast("double") for f in self.features])

        def one(tree: Column) -> Column:
            leaf = _route(values, tree, self.depth)
            if sampled is None:
                return leaf
            drawn = sample_weight(self.seed, tree, F.col(self.key)) > 0
            return F.when(drawn if sampled else ~drawn, leaf)

        said = F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), one)
        counts = [F.size(F.array_compact(F.transform("__said", _when_equal(c)))) for c in range(len(self.classes))]
        routed = _with_arrays(df, features, cuts, ends, "double").withColumn("__said", said)
        return routed.withColumn("votes", F.array(*counts)).drop("__said", *ARRAYS)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """The class with most votes, the first of equals; NULL for a row whose NULL stops every tree."""
        return self.votes(df).withColumn(out, self._winner()).drop("votes")

    def _winner(self) -> Column:
        most = F.array_max("votes")
        return F.when(most > 0, F.get(F.array(*[F.lit(c) for c in self.classes]), (F.array_position("votes", most) - 1).cast("int")))

    def out_of_bag(self, df: DataFrame, label: str) -> DataFrame:
        """One row: rows that some tree did not draw, and how many of them those trees get wrong."""
        size = 1 << (self.depth + 1)
        features, ends = np.full((self.trees, size), -1, np.int32), np.zeros((self.trees, size), np.int64)
        cuts = np.zeros((self.trees, size))
        for t, node, feature, cut, _, counts in self.nodes:
            ends[t, node] = max(range(len(counts)), key=lambda c: (counts[c], -c))
            if feature is not None:
                features[t, node], cuts[t, node] = self.features.index(feature), cut
        trees, depth, seed, classes = self.trees, self.depth, self.seed, len(self.classes)
        width = len(self.features)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                keys = batch.column(0).to_pylist()
                actual = batch.column(1).fill_null(-2).to_numpy(zero_copy_only=False)
                values = [batch.column(2 + f) for f in range(width)]
                known = np.array([v.is_valid().to_numpy(zero_copy_only=False) for v in values]).T.ravel()
                x = np.array([v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in values]).T.ravel()
                votes = np.zeros((n, classes), np.int32)
                for t in range(trees):
                    at = np.flatnonzero(_drawn(seed, t, keys) == 0)
                    alive = np.ones(len(at), bool)
                    node = np.ones(len(at), np.int64)
                    for _ in range(depth):
                        f = features[t][node]
                        cell = at * width + np.maximum(f, 0)
                        alive &= (f < 0) | known[cell]  # a NULL stops the tree
                        node = np.where(f < 0, node, 2 * node + ~(x[cell] <= cuts[t][node]))  # NaN is above every cut
                    votes[at[alive], ends[t][node[alive]]] += 1
                voted = votes.max(1) > 0
                wrong = voted & (actual != -2) & (votes.argmax(1) != actual)
                yield pa.RecordBatch.from_pydict({"rows": pa.array([int(voted.sum())], pa.int64()), "wrong": pa.array([int(wrong.sum())], pa.int64())})

        importable(df.sparkSession)
        key = F.col(self.key).cast("string").alias("key")
        y = _class_number(self.classes, label).alias("y")
        cells = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)]
        sums = df.select(key, y, *cells).mapInArrow(judge, "rows long, wrong long") if classes else df.sparkSession.createDataFrame([], "rows long, wrong long")
        n, wrong = (F.coalesce(F.sum(c), F.lit(0)) for c in ("rows", "wrong"))
        return sums.agg(F.lit(trees).alias("trees"), n.alias("rows"), wrong.alias("wrong"), F.try_divide(wrong.cast("double"), n).alias("error"))


def _class_number(classes: list, label: str) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1) if classes else F.lit(None).cast("int")


def _drawn(seed: int, tree: int, keys: Sequence[str | None]) -> np.ndarray:
    """``sample_weight`` of many keys: how often each is drawn for the tree."""
    start = hashlib.md5(f"{seed}|{tree}".encode())

    def word(key: str | None) -> int:
        digest = start.copy()
        if key is not None:
            digest.update(b"|" + key.encode("utf-8", "surrogatepass"))
        return int.from_bytes(digest.digest()[:4], "big")

    bounds = np.array([int(b, 16) for b in poisson_bounds()], np.int64)
    return np.searchsorted(bounds, np.fromiter(map(word, keys), np.int64, len(keys)), "right").astype(np.uint8)


def _with_arrays(df: DataFrame, features: list[list[int]], cuts: list[list], ends: list[list[int]], kind: str) -> DataFrame:
    """The trees' feature, cut and end of each node as three columns, from a subquery of one row."""
    one = df.sparkSession.createDataFrame([(features, cuts, ends)], f"f array<array<int>>, c array<array<{kind}>>, e array<array<int>>")
    return df.withColumns({name: one.select(c).scalar() for name, c in zip(ARRAYS, "fce")})


def _route(values: Column, tree: Column, depth: int) -> Column:
    """The end of the node that the values reach in ``_with_arrays``' trees: node 1 is the root, a node without feature stays."""
    features, cuts, ends = (F.get(F.col(name), tree) for name in ARRAYS)

    def down(node: Column, _: Column) -> Column:
        feature = F.get(features, node)
        return F.when(feature < 0, node).otherwise(node * 2 + (F.get(values, feature) > F.get(cuts, node)).cast("int"))

    if not depth:
        return F.get(ends, F.lit(1))
    return F.get(ends, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down))


def candidate_cuts(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """At most ``bins`` cuts per feature (value <= cut goes left), from one mergeable sketch per feature.

    Every value that holds more than a share of 1 / (2 bins) of the rows is a cut, but for the largest.
    """
    marks = [i / (2 * bins) for i in range(1, 2 * bins)]
    found = df.agg(*[F.struct(F.percentile_approx(F.col(f).cast("double"), marks, 100 * bins), F.max(F.col(f).cast("double"))) for f in features]).first()
    out = {}
    for f, (cuts, top) in zip(features, found):
        values = sorted({c for c in cuts or [] if c < top})
        step = max(1, -(-len(values) // bins))
        out[f] = values[step - 1 :: step] if step > 1 else values
    return out


def grow(
    df: DataFrame, features: Sequence[str], label: str, key: str | None = None, trees: int = 1, depth: int = 5, min_leaf: int = 4, bins: int = 32,
    sampled: bool = False, per_node: int | None = None, seed: int = 1,
) -> Forest:
    """Grow ``trees`` classification trees by Gini impurity.

    With ``sampled`` every tree sees each row as often as a hash of tree and ``key`` says (bagging);
    with ``per_node`` a node may cut at that many features only, picked by a hash (random forest).
    A cut must leave ``min_leaf`` drawn rows on both sides and lower the impurity; of equal cuts
    the first feature and lowest value wins. Rows with a NULL feature or label are left out. A
    level costs one pass over the rows and one shuffle of (trees x nodes x features x bins x classes) counts at most.
    """
    if depth > DEEPEST:
        raise ValueError(f"depth is at most {DEEPEST}")
    features = list(features)
    known = df.dropna(subset=[*features, label])
    classes = [r[0] for r in known.groupBy(label).count().orderBy(label).limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    forest = Forest(features, classes, trees, depth, key, seed)
    if not classes:
        return forest
    cuts = candidate_cuts(known, features, bins)
    # A row keeps the number of its bin per feature: how many cuts lie below the value.
    binned = F.array(*[_bin(F.col(f).cast("double"), cuts[f]) for f in features])
    y = _class_number(classes, label)
    # Bins and draws are found once and stored, so that a level only routes and counts.
    rows = materialize(_stored(known.select((F.col(key) if key else F.lit(None)).cast("string").alias("key"), binned.alias("bins"), y.alias("y")), trees, seed, sampled), "binned")
    size = 1 << (depth + 1)
    few = len(features) if per_node is None else min(per_node, len(features))
    chosen, bounds = np.full((trees, size), -1, np.int32), np.zeros((trees, size), np.int32)
    open_ = [(t, 1) for t in range(trees)]  # the nodes still to be split
    bins_most = max(len(c) for c in cuts.values()) + 1
    at_once = max(1, MOST_CELLS // (few * bins_most * len(classes)))
    cut_of: dict[tuple[int, int], tuple[str, float]] = {}
    for level in range(depth):
        tried = {(t, n): _tried(seed, t, n, len(features), per_node) for t, n in open_}
        splits = []
        for i in range(0, len(open_), at_once):
            found = _best_cuts(rows, chosen, bounds, level, {node: tried[node] for node in open_[i : i + at_once]}, bins_most, len(classes), min_leaf)
            splits += found.collect()  # one row per node that splits
        open_ = []
        for t, n, f, b in sorted(splits):
            chosen[t, n], bounds[t, n] = f, b
            cut_of[t, n] = (features[f], cuts[features[f]][b])
            open_ += [(t, 2 * n), (t, 2 * n + 1)]
        if not splits:
            break
    at_once = max(1, MOST_CELLS // (size * len(classes)))
    leaves = []
    for i in range(0, trees, at_once):
        some = range(i, min(i + at_once, trees))
        places = {t: (np.arange(size), np.zeros((size, 0), np.int64)) for t in some}
        leaves += _summed(_counted(rows, chosen, bounds, depth, places, 1, len(classes)), {t: size * len(classes) for t in some}).collect()
    counts: dict[tuple[int, int], list[int]] = {}
    for t, at, found in leaves:
        cells = np.zeros(size * len(classes), np.int64)
        cells[np.frombuffer(at, np.int64)] = np.frombuffer(found, np.int64)
        values = cells.reshape(size, -1)
        for leaf in np.flatnonzero(values.sum(1)):
            n = int(leaf)
            while n:
                total = counts.setdefault((t, n), [0] * len(classes))
                counts[t, n] = [a + int(b) for a, b in zip(total, values[leaf])]
                n //= 2
    forest.nodes = [(t, n, *cut_of.get((t, n), (None, None)), sum(c), c) for (t, n), c in sorted(counts.items())]
    return forest


def _stored(rows: DataFrame, trees: int, seed: int, sampled: bool) -> DataFrame:
    """(y, bins, drawn) of (key, bins, y) rows: two bytes per feature, and one per tree that says how often it draws the row."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = batch.column(0).to_pylist(), batch.num_rows
            drawn = np.ones((n, trees), np.uint8)
            for t in range(trees if sampled else 0):
                drawn[:, t] = _drawn(seed, t, keys)
            bins = [np.array(b, np.uint16).tobytes() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(bins, pa.binary()), pa.array([d.tobytes() for d in drawn], pa.binary())], names=["y", "bins", "drawn"])

    importable(rows.sparkSession)
    return rows.mapInArrow(draw, "y int, bins binary, drawn binary")


def _counted(rows: DataFrame, chosen: np.ndarray, bounds: np.ndarray, level: int, places: dict[int, tuple[np.ndarray, np.ndarray]], bins: int, classes: int) -> DataFrame:
    """(tree, at, n): per task, the drawn rows by (place, tried feature, bin, class), as far as there are any.

    ``places`` has, for each tree, the place of a node among those to be counted (-1: not one), and the features tried there; without features a place has its classes only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {t: np.zeros(len(tried) * max(1, tried.shape[1]) * bins * classes, np.int64) for t, (_, tried) in places.items()}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y = batch.column(0).to_numpy().astype(np.int64)
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).astype(np.int64)
            width = len(x) // n
            drawn = np.ascontiguousarray(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1).T)
            for t, (place, tried) in places.items():
                at = np.flatnonzero(drawn[t])
                node = np.ones(len(at), np.int64)
                for _ in range(level):
                    f = chosen[t][node]
                    node = np.where(f < 0, node, 2 * node + (x[at * width + np.maximum(f, 0)] > bounds[t][node]))
                here = place[node]
                open_ = here >= 0
                at, here = at[open_], here[open_]
                if not len(at):
                    continue
                w, last = drawn[t][at], y[at]
                few = tried.shape[1]
                if not few:
                    cells[t] += np.bincount(here * classes + last, w, len(cells[t])).astype(np.int64)
                for j in range(few):
                    bin_ = x[at * width + tried[here, j]]
                    key = ((here * few + j) * bins + bin_) * classes + last
                    cells[t] += np.bincount(key, w, len(cells[t])).astype(np.int64)
        for t, found in cells.items():
            some = np.flatnonzero(found)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([some.astype(np.int64).tobytes()], pa.binary()), pa.array([found[some].tobytes()], pa.binary())], names=["tree", "at", "n"])

    importable(rows.sparkSession)
    return rows.mapInArrow(count, "tree int, at binary, n binary")


def _per_tree(counted: DataFrame, sizes: dict[int, int], made: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``made`` of each tree and its counts summed over the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, cells = None, np.zeros(0, np.int64)
        for batch in batches:
            for t, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if t != tree:
                    if tree is not None:
                        yield made(tree, cells)
                    tree, cells = t, np.zeros(sizes[t], np.int64)
                cells[np.frombuffer(at, np.int64)] += np.frombuffer(n, np.int64)
        if tree is not None:
            yield made(tree, cells)

    return counted.repartition("tree").sortWithinPartitions("tree").mapInArrow(add, schema)


def _summed(counted: DataFrame, sizes: dict[int, int]) -> DataFrame:
    def made(tree: int, cells: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(cells)
        return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([some.astype(np.int64).tobytes()], pa.binary()), pa.array([cells[some].tobytes()], pa.binary())], names=["tree", "at", "n"])

    return _per_tree(counted, sizes, made, "tree int, at binary, n binary")


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < value))


def _when_equal(c: int) -> Callable[[Column], Column]:
    return lambda s: F.when(s == c, s)


def _tried(seed: int, tree: int, node: int, features: int, per_node: int | None) -> list[int]:
    """The ``per_node`` features whose digests are lowest for this tree and node; all of them without ``per_node``."""
    if per_node is None or per_node >= features:
        return list(range(features))
    return sorted(sorted(range(features), key=lambda f: hashlib.md5(f"{seed}|{tree}|{node}|{f}".encode()).hexdigest())[:per_node])


def _best_cuts(rows: DataFrame, chosen: np.ndarray, bounds: np.ndarray, level: int, tried: dict[tuple[int, int], list[int]], bins: int, classes: int, min_leaf: int) -> DataFrame:
    """(tree, node, feature, bin) of the nodes that are worth a cut: rows up to the bin go left.

    ``tried`` has the features of each open (tree, node). Only these are counted.
    """
    nodes: dict[int, list[int]] = {}
    for t, n in tried:
        nodes.setdefault(t, []).append(n)
    places = {}
    for t, some in nodes.items():
        place = np.full(chosen.shape[1], -1, np.int64)
        place[some] = np.arange(len(some))
        places[t] = (place, np.array([tried[t, n] for n in some], np.int64))
    few = len(next(iter(tried.values())))

    def made(tree: int, cells: np.ndarray) -> pa.RecordBatch:
        left = np.cumsum(cells.reshape(-1, few, bins, classes), 2)
        total = left[:, :, -1:, :]

        def weigh(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = counts.sum(-1)
            return n, (counts * counts).sum(-1).astype(float) / np.where(n > 0, n, 1)

        n_left, pure_left = weigh(left)
        n_right, pure_right = weigh(total - left)
        score = pure_left + pure_right
        worth = (n_left >= max(min_leaf, 1)) & (n_right >= max(min_leaf, 1)) & (score > weigh(total)[1] * (1 + 1e-12))
        score = np.where(worth, score, -1.0).reshape(len(score), -1)
        at = score.argmax(1)  # the first feature and bin of equal scores
        splits = np.flatnonzero(score[np.arange(len(at)), at] >= 0)
        feature = places[tree][1][splits, at[splits] // bins]
        columns = (np.full(len(splits), tree), np.array(nodes[tree])[splits], feature, at[splits] % bins)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["tree", "node", "f", "bin"])

    sizes = {t: len(some) * few * bins * classes for t, some in nodes.items()}
    return _per_tree(_counted(rows, chosen, bounds, level, places, bins, classes), sizes, made, "tree int, node int, f int, bin int")
