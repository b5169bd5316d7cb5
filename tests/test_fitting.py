"""Models fitted by aggregations, against NumPy, plain loops and their optimality conditions."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.models import lloyd, logit, trees
from tidebook.operators import sketches
from tidebook.operators.sampling import hash_order

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(500, 3)) * [2, 3, 1] + [0, 50, 1], 1)
    y = (x @ [0.8, 0.3, -1.0] + rng.normal(size=500) * 0.7 > 14).astype(int)
    data = [(i, *map(float, r), int(t), "no" if t else "yes") for i, (r, t) in enumerate(zip(x, y))]
    data += [(9000, None, 1.0, 1.0, 1, "no"), (9001, 1.0, 1.0, 1.0, None, None)]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y int, name string").repartition(5).cache(), x, y


# ---- logistic regression


def slope_at(x, y, weights, intercept, penalty):
    q = 1 / (1 + np.exp(-(x @ weights + intercept)))
    return np.concatenate([[np.sum(q - y)], x.T @ (q - y) + penalty * np.array(weights)])


def test_logit_slope_vanishes(sample, penalty=0.1):
    df, x, y = sample
    model = logit.fit(df, X, "y", penalty)
    assert model.gradient < 1e-8 and model.passes < 20
    assert np.abs(slope_at(x, y, model.weights, model.intercept, penalty)).max() < 1e-6
    table = {r.feature: r.weight for r in model.table(df).collect()}
    assert list(table) == [*X, "intercept"] and table["a"] > 0 > table["c"]
    got = df.where("id < 9000").select(F.avg(((model.probability() > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert got == pytest.approx(np.mean((x @ model.weights + model.intercept > 0) == y)) and got > 0.8


def test_logit_settles_on_separable_and_one_sided_labels(spark):
    far = spark.createDataFrame([(float(i * 100), int(i > 20)) for i in range(40)], "x double, y int")
    model = logit.fit(far, ["x"], "y", 1e-3)
    assert model.gradient < 1e-5 and far.where(((model.margin() > 0).cast("int")) != F.col("y")).count() == 0
    same = logit.fit(spark.createDataFrame([(1.0, 1)] * 9, "x double, y int"), ["x"], "y")
    assert math.isfinite(same.intercept) and same.intercept > 5
    assert logit.fit(far.limit(0), ["x"], "y").weights == [0.0]
    assert logit.fit(far, [], "y").intercept == pytest.approx(math.log(19 / 21))


# ---- clusters


def brute_lloyd(rows, k, rounds, seed=1):
    ids, z = [r[0] for r in rows], np.array([r[1:] for r in rows], float)
    z = (z - z.mean(0)) / np.where(z.std(0) == 0, 1, z.std(0))
    h = [hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in ids]
    centres = [z[min(range(len(z)), key=lambda i: h[i])]]
    while len(centres) < k:
        gap = [round(min(float(((p - c) ** 2).sum()) for c in centres), 9) for p in z]
        centres.append(z[max(range(len(z)), key=lambda i: (gap[i], h[i]))])
    for _ in range(rounds):
        gaps = np.array([[round(float(((p - c) ** 2).sum()), 9) for c in centres] for p in z])
        at = gaps.argmin(1)
        centres = [z[at == i].mean(0) if (at == i).any() else centres[i] for i in range(k)]
    return dict(zip(ids, at))


def test_lloyd_equals_plain_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v), float(w), 5.0) for i, (v, w) in enumerate(np.round(rng.normal(size=(300, 2)) + rng.integers(0, 3, (300, 1)) * 4, 1))]
    df = spark.createDataFrame([*rows, (999, None, 1.0, 5.0)], "id int, p double, q double, flat double").repartition(4)
    model = lloyd.fit(df, ["p", "q", "flat"], "id", 4, 30)
    got = {r.id: r.cluster for r in model.assign(df).collect()}
    assert got.pop(999) is None and got == brute_lloyd(rows, 4, 30)
    np.testing.assert_allclose(lloyd.fit(df.repartition(1).orderBy("q"), ["p", "q", "flat"], "id", 4, 30).centres, model.centres)
    assert lloyd.summary(df, model).agg(F.sum("cnt")).first()[0] == 300


def test_lloyd_with_few_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, p double")
    assert {r.cluster for r in lloyd.fit(df, ["p"], "id", 3).assign(df).collect()} == {0}
    empty = df.limit(0)
    assert lloyd.summary(empty, lloyd.fit(empty, ["p"], "id", 3)).count() == 0


# ---- trees


def gini_tree(x, y, w, cuts, classes, depth, min_leaf, allowed, node=1, out=None):
    """Plain recursion; cuts come from outside."""
    out = {} if out is None else out
    counts = [int(w[y == c].sum()) for c in range(classes)]
    out[node] = [None, None, counts]
    if depth:
        def pure(m):
            n = w[m].sum()
            return sum(int(w[m & (y == c)].sum()) ** 2 for c in range(classes)) / n

        best = None
        for f in allowed(node):
            for b, cut in enumerate(cuts[f]):
                left = x[:, f] <= cut
                if not w[left].sum() or min(w[left].sum(), w[~left].sum()) < min_leaf:
                    continue
                score = pure(left) + pure(~left)
                if score > pure(w > -1) * (1 + 1e-12) and (best is None or score > best[0]):
                    best = (score, f, cut)
        if best:
            _, f, cut = best
            out[node][:2] = [f, cut]
            left = x[:, f] <= cut
            for side, child in ((left, 2 * node), (~left, 2 * node + 1)):
                gini_tree(x[side], y[side], w[side], cuts, classes, depth - 1, min_leaf, allowed, child, out)
    return out


def as_tree(forest, tree=0):
    return {n: [None if f is None else forest.features.index(f), cut, counts] for t, n, f, cut, _, counts in forest.nodes if t == tree}


def test_tree_equals_plain_recursion(sample):
    df, x, y = sample
    known = df.where("id < 9000")
    found = trees.candidate_cuts(known, X, 16)
    cuts = [found[f] for f in X]
    assert all(len(c) <= 16 and c == sorted(set(c)) and max(c) < x[:, i].max() for i, c in enumerate(cuts))
    forest = trees.grow(df, X, "name", depth=4, min_leaf=5, bins=16)
    assert forest.classes == ["no", "yes"]
    want = gini_tree(x, np.where(y == 1, 0, 1), np.ones(len(y), int), cuts, 2, 4, 5, lambda _: range(3))
    assert as_tree(forest) == want
    said = forest.predict(known)
    assert said.agg(F.avg((F.col("prediction") == F.col("name")).cast("double"))).first()[0] > 0.85
    assert forest.table(df).count() == len(want)


def test_forest_draws_by_hash_and_measures_out_of_bag(sample):
    df, x, y = sample
    known = df.where("id < 9000")
    forest = trees.grow(df, X, "y", "id", trees=6, depth=3, min_leaf=2, bins=8, sampled=True, per_node=2, seed=4)
    again = trees.grow(df.repartition(2).orderBy("c"), X, "y", "id", trees=6, depth=3, min_leaf=2, bins=8, sampled=True, per_node=2, seed=4)
    assert forest.nodes == again.nodes and len({str(as_tree(forest, t)) for t in range(6)}) > 3

    def word(*parts):
        return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()

    bounds = trees.poisson_bounds()
    weights = np.array([[sum(word(4, t, i)[:8] >= b for b in bounds) for i in range(500)] for t in range(6)])
    assert abs(weights.mean() - 1) < 0.05 and abs((weights == 0).mean() - math.exp(-1)) < 0.03
    found = trees.candidate_cuts(known, X, 8)
    cuts = [found[f] for f in X]
    for t in range(6):
        def allowed(node):
            return sorted(sorted(range(3), key=lambda f: word(4, t, node, f))[:2])

        assert as_tree(forest, t) == gini_tree(x, y, weights[t], cuts, 2, 3, 2, allowed), t
    # Votes of the trees that did not draw a row.
    said = np.zeros((500, 2), int)
    for t in range(6):
        nodes = as_tree(forest, t)
        for i in np.flatnonzero(weights[t] == 0):
            node = 1
            while nodes[node][0] is not None:
                node = 2 * node + int(x[i, nodes[node][0]] > nodes[node][1])
            said[i, int(np.argmax(nodes[node][2]))] += 1
    out = said.sum(1) > 0
    wrong = int((said.argmax(1) != y)[out].sum())
    got = forest.out_of_bag(known, "y").first()
    assert tuple(got)[:3] == (6, int(out.sum()), wrong) and got.error == pytest.approx(wrong / out.sum())


def test_trees_on_awkward_tables(spark):
    df = spark.createDataFrame([(i, float(i % 2), 7.0, "k") for i in range(20)], "id int, v double, flat double, label string")
    one = trees.grow(df, ["v", "flat"], "label", depth=3)
    assert one.nodes == [(0, 1, None, None, 20, [20])] and {r.prediction for r in one.predict(df).collect()} == {"k"}
    assert trees.grow(df.limit(0), ["v"], "label").nodes == []
    three = df.withColumn("label", F.col("id") % 3)
    assert len(trees.grow(three.withColumn("v", F.col("id").cast("double")), ["v"], "label", depth=5, min_leaf=1).classes) == 3
    with pytest.raises(ValueError):
        trees.grow(df, ["v"], "label", depth=40)


# ---- sketches


def test_day_sketches_merge_within_the_bound(spark):
    rng = np.random.default_rng(1)
    hot = rng.lognormal(0, 3, 60_000)
    data = [("hot", int(i % 30), float(v)) for i, v in enumerate(hot)] + [("few", 3, float(v)) for v in (5, 1, 9)] + [("none", 1, None), (None, 2, 4.0), ("odd", 2, float("nan"))]
    df = spark.createDataFrame(data, "k string, d int, v double").withColumn("at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).repartition(6)
    qs = [0.0, 0.01, 0.5, 0.8, 0.95, 1.0]
    stored = sketches.day_sketches(df, ["k"], "at", "v")
    assert stored.where("k = 'hot'").count() == 30 and stored.where("k IN ('none', 'odd')").count() == 0
    answers = sketches.percentiles(sketches.span_sketches(stored, ["k"]), ["k"], qs)
    errors = {r.k: (r.n, r.error) for r in sketches.rank_errors(df.where("k IS NOT NULL"), ["k"], "v", answers, qs).collect()}
    assert errors["hot"][0] == 60_000 and errors["hot"][1] <= sketches.RANK_ERROR
    few = answers.where("k = 'few'").first()
    assert (few.p0, few.p2, few.p5, few.cnt) == (1.0, 5.0, 9.0, 3)
    span = sketches.span_sketches(stored, ["k"], "2024-01-05", "2024-01-08").where("k = 'hot'").first()
    assert span.cnt == 6000
    part = np.sort(np.concatenate([hot[d::30] for d in (4, 5, 6)]))
    got = sketches.percentiles(sketches.span_sketches(stored, ["k"], "2024-01-05", "2024-01-08").where("k = 'hot'"), ["k"], [0.8]).first().p0
    assert abs(np.searchsorted(part, got) / 6000 - 0.8) <= sketches.RANK_ERROR


def test_wrong_answers_are_measured(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(100)], "k string, v double")
    answers = spark.createDataFrame([("k", 10.0)], "k string, p0 double")
    assert sketches.rank_errors(df, ["k"], "v", answers, [0.5]).first().error == pytest.approx(0.39)
