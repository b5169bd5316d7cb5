"""The whole forest: its size, its counts in several passes, and rows without a value or key."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA
from tidebook.models import classifiers, trees

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    a, b, c = F.col("id") % 7, F.pmod(F.col("id") * 13, F.lit(11)), F.pmod(F.col("id") * 5, F.lit(3))
    return spark.range(240).select(
        F.when(F.col("id") % 50 > 0, F.col("id")).alias("id"), F.when(F.col("id") % 17 > 0, a).cast("double").alias("a"), b.cast("double").alias("b"), c.alias("c"),
        F.when(F.col("id") % 31 > 0, (a + b + F.col("id") % 4 > 9).cast("int")).alias("y")).repartition(3)


def test_registered_forest_is_whole(spark):
    """The model's 150 trees of depth 10, not a few shallow ones."""
    model = classifiers.random_forest("y")
    got = entry.queries()["random_forest"](spark, DATA).first()
    assert (got.trees, model.getNumTrees(), model.getMaxDepth()) == (150, 150, 10)
    assert "n10 AS" in entry.oracle_sql()["random_forest"] and "range(0, 150)" in entry.oracle_sql()["random_forest"]


def test_several_passes_give_the_same_forest(rows, monkeypatch):
    whole = trees.grow(rows, X, "y", "id", trees=5, depth=4, min_leaf=1, sampled=True, per_node=2)
    monkeypatch.setattr(trees, "MOST_CELLS", 1)
    assert trees.grow(rows, X, "y", "id", trees=5, depth=4, min_leaf=1, sampled=True, per_node=2).nodes == whole.nodes
    assert len(whole.nodes) > 30


def test_out_of_bag_counts_votes(rows):
    """The counts equal those of the vote column, also where a value, key or label is NULL."""
    forest = trees.grow(rows, X, "y", "id", trees=4, depth=3, sampled=True)
    voted = forest.votes(rows, sampled=False).where(F.array_max("votes") > 0)
    want = voted.agg(F.count(F.lit(1)), F.count_if(forest._winner() != F.col("y"))).first()
    got = forest.out_of_bag(rows, "y").first()
    assert (got.rows, got.wrong) == tuple(want) and 0 < got.wrong < got.rows < 240
    none = forest.out_of_bag(rows.limit(0), "y").first()
    assert (none.trees, none.rows, none.wrong, none.error) == (4, 0, 0, None)


def test_draws_equal_the_hash(spark, rows):
    got = rows.select("id", *[trees.sample_weight(3, F.lit(t), F.col("id")).alias(f"t{t}") for t in range(12)]).collect()
    keys = [None if r.id is None else str(r.id) for r in got]
    assert [[r[f"t{t}"] for r in got] for t in range(12)] == [trees._drawn(3, t, keys).tolist() for t in range(12)]
