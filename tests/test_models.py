import threading

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tidebook.models import classifiers, moments, regression
from tidebook.models import text as text_models
from tidebook.operators.sampling import hash_share

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 4, 0.5] + [0, 2, 1]
    y = x @ [2.0, -0.5, 0.0] + 3 + rng.normal(size=400) * 0.3
    k = (x @ [1.0, 0.4, 0.0] > 0.8).astype(int)
    data = [(i, *map(float, r), float(t), int(c)) for i, (r, t, c) in enumerate(zip(x, y, k))]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, y double, k int").repartition(5).cache()
    return df, x, y, k


def test_linear_matches_normal_equations(sample):
    df, x, y, _ = sample
    model = regression.linear(df, X, "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    np.testing.assert_allclose([*model.coefficients, model.intercept], want, rtol=1e-8)
    got = df.select(F.avg(F.abs(F.col("y") - regression.predicted(model, X)))).first()[0]
    assert got == pytest.approx(np.abs(y - np.c_[x, np.ones(len(x))] @ want).mean())


def test_ridge_matches_closed_form(sample):
    df, x, _, k = sample
    model = regression.ridge_classifier(df, X, "k", alpha=10.0)
    xc, yc = x - x.mean(0), (2.0 * k - 1) - (2.0 * k - 1).mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(list(model.coefficients), want, rtol=1e-6)


def test_lasso_satisfies_its_optimality_conditions(sample):
    df, x, y, _ = sample
    alpha = 0.1
    model = regression.lasso(df, X, "y", alpha)
    w = np.array(list(model.coefficients))
    grad = (x - x.mean(0)).T @ (y - x @ w - model.intercept) / len(y)
    for weight, g in zip(w, grad):
        if abs(weight) > 1e-9:
            assert g == pytest.approx(alpha * np.sign(weight), abs=1e-4)
        else:
            assert abs(g) <= alpha + 1e-4
    assert w[2] == 0.0


def test_cross_validation_against_numpy(sample):
    df, x, y, _ = sample
    fold = dict(df.select("id", F.floor(regression.hash_share(1, "id") * 5)).collect())
    f = np.array([fold[i] for i in range(len(y))])
    for row in regression.cross_validate(df, X, "y", "id", 5).collect():
        train, test = f != row.fold, f == row.fold
        w = np.linalg.lstsq(np.c_[x, np.ones(len(x))][train], y[train], rcond=None)[0]
        gap = y[test] - np.c_[x, np.ones(len(x))][test] @ w
        assert (row.mae, row.mse) == (pytest.approx(np.abs(gap).mean()), pytest.approx((gap**2).mean()))


def test_grid_weights_match_single_fits(sample):
    df, *_ = sample
    shift = moments.means(df, [*X, "y"])
    got = moments.moments_by(df, [*X, "y"], shift, F.lit(0))[0]
    for alpha in (0.0, 0.05, 0.5):
        weights, _ = got.fit(alpha)
        model = regression.lasso(df, X, "y", alpha) if alpha else regression.linear(df, X, "y")
        np.testing.assert_allclose(weights, list(model.coefficients), atol=1e-4)


def test_feature_rmse(sample):
    df, x, y, _ = sample
    got = {r.feature: r.rmse for r in regression.feature_rmse(df, X, "y").collect()}
    for i, c in enumerate(X):
        slope, const = np.polyfit(x[:, i], y, 1)
        assert got[c] == pytest.approx(np.sqrt(np.mean((y - slope * x[:, i] - const) ** 2)))


def test_cross_validation_is_stable_under_shuffling(sample):
    df, *_ = sample
    a = regression.cross_validate(df, X, "y", "id", 5).orderBy("fold").collect()
    b = regression.cross_validate(df.repartition(3, "a"), X, "y", "id", 5).orderBy("fold").collect()
    assert len(a) == 5 and [r.mae for r in a] == pytest.approx([r.mae for r in b])


def test_grid_search_prefers_a_small_penalty(sample):
    df, *_ = sample
    got = {r.alpha: r.mae for r in regression.grid_search(df, X, "y", "id", [0.001, 5.0], splits=2).collect()}
    assert got[0.001] < got[5.0]


def test_classifiers_reach_a_floor(sample):
    df, *_ = sample
    vectors = regression.assemble(df, X)
    for estimator in (classifiers.logistic("k", 400), classifiers.decision_tree("k"), classifiers.bagged_trees("k", 10), classifiers.random_forest("k", 20)):
        scored = estimator.fit(vectors).transform(vectors)
        assert scored.agg(classifiers.accuracy(scored, "k")).first()[0] > 0.9


def test_cross_validated_accuracy(sample):
    df, *_ = sample
    assert classifiers.cross_validate(regression.assemble(df, X), classifiers.logistic("k", 400), "k", "id", 3) > 0.85


def test_cross_validation_passes_over_stored_folds(sample):
    """Several folds are fitted at a time, on stored rows without a Python step, with the accuracy of Spark's own validator."""
    df, *_ = sample
    rows = regression.assemble(df, X)
    logistic, plans, meet = classifiers.logistic("k", 400), [], threading.Barrier(2, timeout=60)

    class Watched:
        def copy(self):
            return self

        def fit(self, train):
            meet.wait()
            plans.append(train._jdf.queryExecution().executedPlan().toString())
            return logistic.copy().fit(train)

    got = classifiers.cross_validate(rows, Watched(), "k", "id", 4, at_once=2)
    judge = MulticlassClassificationEvaluator(labelCol="k", metricName="accuracy")
    folds = rows.withColumn("fold", F.floor(hash_share(1, "id") * 4).cast("int"))
    want = CrossValidator(estimator=logistic, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=4, foldCol="fold").fit(folds).avgMetrics[0]
    assert got == pytest.approx(want, abs=1e-12) and len(plans) == 4
    assert all("Scan parquet" in p and "Python" not in p for p in plans)
    with pytest.raises(ValueError, match="empty"):
        classifiers.cross_validate(rows.limit(1), logistic, "k", "id", 4)


def test_saved_pipeline_scores_unseen_categories(spark, sample, tmp_path):
    df, *_ = sample
    rows = df.withColumn("cat", F.when(F.col("id") % 2 == 0, "p").otherwise("q"))
    model = classifiers.fit_and_save(classifiers.category_pipeline(["cat"], X, classifiers.random_forest("k", 5)), rows, str(tmp_path / "m"))
    new = model.transform(rows.limit(5).withColumn("cat", F.lit("never seen")))
    assert new.count() == 5 and new.where("prediction IS NULL").count() == 0


def test_class_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "l string, p string")
    got = {r["class"]: tuple(round(v, 4) for v in (r.precision, r.recall, r.f1)) for r in classifiers.class_report(df, "l", "p").collect()}
    assert got == {"a": (1.0, 0.5, 0.6667), "b": (0.3333, 1.0, 0.5), "c": (0.0, 0.0, 0.0)}


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 0, 1, 1), (0, 0, 0, 0)], "a int, b int, c int, d int")
    voted = classifiers.add_votes(df, "abcd")
    assert [(r.vote, r.mean_vote) for r in voted.collect()] == [(1, 1.0), (0, 0.75), (0, 0.0)]
    assert classifiers.risk_counts(voted).first().asDict() == {"any_model": 2, "half_or_more": 1, "below_0_3": 1, "below_0_6": 1}


def test_tfidf_against_brute_force(spark):
    train = ["red red blue", "blue green", "Red one"]
    docs = spark.createDataFrame(list(enumerate(train)), "id int, t string")
    weights = text_models.tfidf(docs, text_models.fit_idf(docs, "id", "t"), "id", "t")
    got = {(r.id, r.term): r.weight for r in weights.collect()}
    idf = np.log(4 / 3) + 1  # red and blue, each in two of three documents
    assert set(got) == {(0, "red"), (0, "blue"), (1, "blue"), (2, "red")}
    norm = np.sqrt((2 * idf) ** 2 + idf**2)
    assert got[(0, "red")] == pytest.approx(2 * idf / norm) and got[(1, "blue")] == pytest.approx(1.0)


def test_text_classifier(spark):
    data = [(i, "кот пёс кошка собака" if i % 2 else "river lake sea water", "ru" if i % 2 else "en") for i in range(40)]
    data += [(90, "кот", None), (91, None, "en"), (92, "unknown words", "en")]
    docs = spark.createDataFrame(data, "id int, t string, lang string")
    model = text_models.fit_text_classifier(docs, "t", "lang", rounds=10)
    scored = model(docs)
    assert scored.where("lang != predicted AND id < 90").count() == 0 and scored.count() == 43
    rest = {r.id: r.predicted for r in scored.where("id >= 90").collect()}
    assert rest[90] == "ru" and rest[91] == rest[92] == model.classes[int(np.argmax(model.bias))]
    weights = {(r.term, r["class"]): r.weight for r in model.table().collect()}
    assert len(weights) == 16 and weights["кот", "ru"] > 0 > weights["river", "ru"]
    empty = text_models.fit_text_classifier(docs.limit(0), "t", "lang")
    assert empty(docs).where("predicted IS NOT NULL").count() == 0


def test_text_rounds_lower_the_loss_and_equal_numpy(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}x" for i in range(30)]
    data = [(i, " ".join(rng.choice(words[c * 6 : c * 6 + 18], 12)), "abc"[c]) for i, c in enumerate(rng.integers(0, 3, 150))]
    docs = spark.createDataFrame(data, "id int, t string, c string").repartition(3)
    rounds, penalty = 5, 1e-2
    model = text_models.fit_text_classifier(docs, "t", "c", "id", rounds=rounds, penalty=penalty)
    tf = np.array([[t.split().count(w) for w in words] for _, t, _ in data], float)
    x = tf * (np.log((1 + len(data)) / (1 + (tf > 0).sum(0))) + 1)
    x = np.c_[x / np.linalg.norm(x, axis=1)[:, None], np.ones(len(x))]
    s = np.where(np.array([[c == k for k in "abc"] for *_, c in data]), 1.0, -1.0)
    w = u = np.zeros((31, 3))
    rate = 1 / (4 + penalty)
    for t in range(rounds):
        g = x.T @ (-2 * s * np.maximum(0, 1 - s * (x @ u))) / len(x)
        g[:-1] += penalty * u[:-1]
        after = u - rate * g
        w, u = after, after + t / (t + 3) * (after - w)
    got = {(r.term, r["class"]): r.weight for r in model.table().collect()}
    np.testing.assert_allclose([[got[t, k] for k in "abc"] for t in words], w[:-1], atol=1e-12)
    np.testing.assert_allclose(model.bias, w[-1], atol=1e-12)
    said = {r.id: r.predicted for r in model(docs, "id").collect()}
    assert [said[i] for i in range(150)] == ["abc"[k] for k in (x @ w).argmax(1)]
    plan = model.margins(docs, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "collect_" not in plan


def test_kmeans_separates_clear_groups(spark):
    data = [(float(i % 2) * 100 + (i % 5), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(data, "x double, z double").withColumn("one", F.lit(1.0))
    groups = classifiers.kmeans_groups(df, ["x"], k=2)
    sizes = {r.cnt for r in groups.groupBy("cluster").agg(F.count("*").alias("cnt"), F.max("x") - F.min("x")).collect()}
    assert sizes == {30}


def test_assembled_vectors(sample):
    df, x, *_ = sample
    got = regression.assemble(df, X).orderBy("id").select(vector_to_array("features").alias("v")).first().v
    np.testing.assert_allclose(got, x[0])
