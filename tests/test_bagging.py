"""Deep bagged trees, a few at a time."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidebook.models import classifiers, regression


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select("id", (F.col("id") % 23).cast("double").alias("a"), (F.col("id") * 7 % 31).cast("double").alias("b"), (F.col("id") % 5 + F.col("id") % 23 > 13).cast("int").alias("y"))
    return regression.assemble(df.repartition(3, "id"), ["a", "b"]).cache()


def votes(model, rows):
    out = model.transform(rows)
    kept = out.select("id", "prediction", vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("r")).orderBy("id").collect()
    return out.columns, np.array([r.prediction for r in kept]), np.array([r.p for r in kept]), np.array([r.r for r in kept])


def test_few_rows_are_fitted_at_once(rows):
    """As before: one forest, equal to that of the plain estimator without stored nodes."""
    model = classifiers.bagged_trees("y", 6).fit(rows)
    plain = classifiers.RandomForestClassifier(labelCol="y", numTrees=6, featureSubsetStrategy="all", minInstancesPerNode=4, maxDepth=30, seed=1).fit(rows)
    assert isinstance(model, RandomForestClassificationModel) and model.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]


def test_many_rows_are_fitted_in_parts(rows, monkeypatch):
    fitted = []
    real = classifiers.RandomForestClassifier._fit
    monkeypatch.setattr(classifiers.RandomForestClassifier, "_fit", lambda self, df: fitted.append((self.getNumTrees(), self.getSeed())) or real(self, df))
    monkeypatch.setattr(classifiers, "ROWS_AT_ONCE", 1500)
    model = classifiers.bagged_trees("y", 7).fit(rows)
    assert [n for n, _ in fitted] == [2, 2, 2, 1] and len({s for _, s in fitted}) == 4
    columns, said, p, raw = votes(model, rows)
    parts = [votes(RandomForestClassificationModel.load(path), rows) for path in model.paths]
    assert columns == parts[0][0]
    np.testing.assert_allclose(raw, sum(x[3] for x in parts), atol=1e-12)
    np.testing.assert_allclose(p, raw / 7, atol=1e-12)
    assert (said == raw.argmax(1)).all() and (said == [int(i % 5 + i % 23 > 13) for i in range(600)]).mean() > 0.9


def test_votes_of_parts(rows, monkeypatch):
    """churn_votes adds the same columns whether the trees are fitted at once or in parts."""
    plain = rows.drop("features")
    want = classifiers.churn_votes(plain, plain, ["a", "b"], "y", 4, 3)
    monkeypatch.setattr(classifiers, "ROWS_AT_ONCE", 1)
    got = classifiers.churn_votes(plain, plain, ["a", "b"], "y", 4, 3)
    assert got.columns == want.columns and got.count() == 600
    same = got.join(want.select("id", *[F.col(c).alias(f"w_{c}") for c in ("ridge", "log_reg", "bagging", "rf")]), "id")
    assert same.where("ridge <> w_ridge OR log_reg <> w_log_reg OR rf <> w_rf").count() == 0 and same.where("bagging <> w_bagging").count() < 60
