"""A stored voting model scores like the fitted one, in another session too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.models import saved


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    data = [(i, float(a), int(b), 5, str(k), int(a + b / 3 + (k == "x") * 2 + e > 2)) for i, (a, b, k, e) in enumerate(
        zip(rng.normal(size=400), rng.integers(0, 9, 400), rng.choice(["x", "y", "z z"], 400), rng.normal(size=400) * 0.2))]
    data += [(900, None, 1, 5, "x", 1), (901, 1.0, 1, 5, None, 0)]
    return spark.createDataFrame(data, "id int, a double, b int, flat int, kind string, y int").repartition(4).cache()


def test_votes_after_loading_equal_those_before(spark, rows, tmp_path):
    path, pick = str(tmp_path / "m"), ["id", *saved.VOTES, "vote", "mean_vote"]
    model = saved.fit(rows.where("id < 300 OR id >= 900"), ["a", "b", "flat"], ["kind"], "y", "id", bagged=3, forest=4, depth=3)
    assert saved.versions(spark, path) == []
    assert model.save(spark, path) == 1
    new = rows.where("id >= 300 AND id < 900").withColumn("kind", F.when(F.col("id") % 10 == 0, "unseen").otherwise(F.col("kind")))
    want = sorted(map(tuple, model.votes(new).select(*pick).collect()))
    back = saved.load(spark.newSession(), path)
    assert back == model  # every number
    assert sorted(map(tuple, back.votes(new).select(*pick).collect())) == want
    right = model.votes(rows.where("id < 300")).agg(*[F.avg((F.col(v) == F.col("y")).cast("double")).alias(v) for v in saved.VOTES]).first()
    assert all(r > 0.8 for r in right)
    # A second version becomes the newest, the first stays.
    second = saved.fit(rows.where("id < 150"), ["a"], [], "y", "id", bagged=2, forest=2, depth=2)
    assert second.save(spark, path) == 2 and saved.versions(spark, path) == [1, 2]
    assert saved.load(spark, path) == second and saved.load(spark, path, 1) == model
    with pytest.raises(ValueError):
        saved.load(spark, path, 3)


def test_scaling_uses_the_training_ranges(spark, rows):
    model = saved.VoteModel(["a", "flat"], [(0.0, 2.0), (5.0, 5.0)], {"kind": ["x", "y"]}, [], [], None, None)
    got = model.prepare(spark.createDataFrame([(4.0, 5, "y"), (1.0, 7, "new"), (1.0, 5, None)], "a double, flat int, kind string")).select(*model.features()).collect()
    assert [tuple(r) for r in got] == [(2.0, 0.0, 0.0, 1.0), (0.5, 2.0, 0.0, 0.0), (0.5, 0.0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        saved.fit(rows.limit(0), ["a"], [], "y", "id")
