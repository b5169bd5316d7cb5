"""Classifiers, clusters and votes."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.models import regression
from tidebook.operators import clean
from tidebook.operators.sampling import hash_share
from tidebook.session import materialize, shared_dir

# Rows times trees of one fit of deep trees: their nodes, more with more rows, lie in the driver at some 300 bytes each.
ROWS_AT_ONCE = 24_000_000


def logistic(label: str, n: int, features: str = "features") -> LogisticRegression:
    """L2 penalty of strength 1 on the summed loss, hence 1 / n on Spark's mean loss."""
    return LogisticRegression(labelCol=label, featuresCol=features, regParam=1.0 / max(n, 1), standardization=False)


def decision_tree(label: str, min_leaf: int = 4, depth: int = 30) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol=label, minInstancesPerNode=min_leaf, maxDepth=depth, seed=1)


class BaggedTrees(RandomForestClassifier):
    """Deep trees of many rows are fitted a few at a time and stored, so that the driver holds only these.

    A fit of at most ``ROWS_AT_ONCE`` rows times trees is one of ``RandomForestClassifier``.
    """

    def _fit(self, dataset: DataFrame) -> Model:
        trees = self.getNumTrees()
        at_once = max(1, ROWS_AT_ONCE // max(dataset.count(), 1))
        if at_once >= trees:
            return super()._fit(dataset)
        paths = []
        for i, start in enumerate(range(0, trees, at_once)):
            some = self.copy({self.numTrees: min(at_once, trees - start), self.seed: self.getSeed() + 1_000_003 * i})
            paths.append(shared_dir(dataset.sparkSession, "trees"))
            super(BaggedTrees, some)._fit(dataset).write().save(paths[-1])
        return StoredTrees(paths, self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol())


class StoredTrees(Model):
    """Forests in folders that vote together. Rows are stored with their votes after each, as only one forest is in the driver at a time."""

    def __init__(self, paths: Sequence[str], raw: str, probability: str, prediction: str):
        super().__init__()
        self.paths, self.columns = list(paths), (raw, probability, prediction)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw, probability, prediction = self.columns
        out, votes = dataset, None
        for path in self.paths:
            forest = RandomForestClassificationModel.load(path).setProbabilityCol("").setPredictionCol("")
            part = vector_to_array(raw)
            voted = forest.transform(out).withColumn("__votes", part if votes is None else F.zip_with("__votes", part, lambda a, b: a + b))
            out, votes = materialize(voted.drop(raw), "votes"), F.col("__votes")
            del forest, voted
        total = F.aggregate(votes, F.lit(0.0), lambda a, b: a + b)
        return out.withColumns({
            raw: array_to_vector(votes), probability: array_to_vector(F.transform(votes, lambda v: v / total)),
            prediction: (F.array_position(votes, F.array_max(votes)) - 1).cast("double")}).drop("__votes")


def bagged_trees(label: str, trees: int = 40, min_leaf: int = 4, depth: int = 30) -> RandomForestClassifier:
    """Bagging: bootstrapped trees that may split on every feature. Rows keep their nodes between the passes; otherwise every task would be sent all trees."""
    return BaggedTrees(labelCol=label, numTrees=trees, featureSubsetStrategy="all", bootstrap=True, minInstancesPerNode=min_leaf, maxDepth=depth, seed=1, cacheNodeIds=True)


def random_forest(label: str, trees: int = 150, depth: int = 10) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=1)


def accuracy(df: DataFrame, label: str, prediction: str = "prediction") -> Column:
    return F.avg((F.col(label) == F.col(prediction)).cast("double"))


def cross_validate(df: DataFrame, estimator, label: str, key: str, k: int, seed: int = 1, at_once: int = 4) -> float:
    """Mean accuracy over ``k`` hash-made folds.

    Rounds of a fit are short jobs that leave cores idle, so ``at_once`` folds are fitted at a
    time. Rows are stored once with their fold; every fold reads them from there.
    """
    folds = materialize(df.withColumn("fold", F.floor(hash_share(seed, key) * k).cast("int")), "folds")
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")

    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    for fold in range(k):
        if not sizes.get(fold) or sizes[fold] == sum(sizes.values()):
            raise ValueError(f"The training or validation data at fold {fold} is empty.")

    def judged(fold: int) -> float:
        model = estimator.copy().fit(folds.where(F.col("fold") != fold))
        return judge.evaluate(model.transform(folds.where(F.col("fold") == fold)))

    with ThreadPoolExecutor(at_once) as pool:
        return float(np.mean([[score] for score in pool.map(inheritable_thread_target(df.sparkSession)(judged), range(k))], axis=0)[0])


def category_pipeline(categories: Sequence[str], numbers: Sequence[str], estimator) -> Pipeline:
    """Index and one-hot the categories, append the numbers, then fit ``estimator``."""
    index = StringIndexer(inputCols=list(categories), outputCols=[f"{c}_ix" for c in categories], stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_ix" for c in categories], outputCols=[f"{c}_hot" for c in categories], dropLast=False)
    vector = VectorAssembler(inputCols=[*numbers, *[f"{c}_hot" for c in categories]], outputCol="features")
    return Pipeline(stages=[index, hot, vector, estimator])


def fit_and_save(stages: Pipeline, train: DataFrame, path: str) -> PipelineModel:
    """Fit on the training rows and store all fitted stages, for scoring unseen rows later."""
    stages.fit(train).write().overwrite().save(path)
    return PipelineModel.load(path)


def kmeans_groups(df: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 1) -> DataFrame:
    """Clusters of the standardised columns; the rows keep their unscaled values."""
    scaled = clean.standardize(df.withColumns({f"__z_{c}": F.col(c).cast("double") for c in columns}), [f"__z_{c}" for c in columns])
    vectors = regression.assemble(scaled, [f"__z_{c}" for c in columns])
    model = KMeans(k=k, seed=seed).fit(vectors)
    return model.transform(vectors).withColumnRenamed("prediction", "cluster").drop("features", *[f"__z_{c}" for c in columns])


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("cnt"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the (small) confusion table."""
    counts = confusion(df, label, prediction)
    hit = F.when(F.col(label) == F.col(prediction), F.col("cnt")).otherwise(0)
    actual = counts.groupBy(F.col(label).alias("class")).agg(F.sum("cnt").alias("support"), F.sum(hit).alias("hits"))
    said = counts.groupBy(F.col(prediction).alias("class")).agg(F.sum("cnt").alias("said"))
    joined = actual.join(said, "class", "left")
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("said")), F.lit(0.0))
    recall = F.col("hits") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return joined.withColumns({"precision": precision, "recall": recall}).select("class", "precision", "recall", f1.alias("f1"), "support")


def regression_errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    gap = F.col(label) - F.col(prediction)
    return df.agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def add_votes(df: DataFrame, votes: Sequence[str]) -> DataFrame:
    """The product of 0/1 votes (0 if any model says 0) and their mean."""
    product, total = F.lit(1), F.lit(0)
    for v in votes:
        product, total = product * F.col(v), total + F.col(v)
    return df.withColumns({"vote": product.cast("int"), "mean_vote": total / F.lit(float(len(votes)))})


def risk_groups(voted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and column means per mean vote: 0 is the group every model expects to leave."""
    return voted.groupBy("mean_vote").agg(F.count(F.lit(1)).alias("cnt"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


def risk_counts(voted: DataFrame, thresholds: Sequence[float] = (0.3, 0.6)) -> DataFrame:
    """How many rows any model, and most models, expect to leave."""
    named = {"any_model": F.count_if(F.col("vote") == 0), "half_or_more": F.count_if(F.col("mean_vote") <= 0.5)}
    named |= {f"below_{str(t).replace('.', '_')}": F.count_if(F.col("mean_vote") < t) for t in thresholds}
    return voted.agg(*[c.alias(n) for n, c in named.items()])


def churn_votes(train: DataFrame, score: DataFrame, features: Sequence[str], label: str, trees: int = 40, forest: int = 150) -> DataFrame:
    """Fit ridge, logistic, bagged trees and a random forest; add one 0/1 column each to ``score``.

    Features are scaled to 0..1 by the range of the training rows.
    """
    columns = list(features)
    fit_rows, score_rows = clean.minmax(train, columns), clean.minmax(score, columns, fitted_on=train)
    fit_vectors = regression.assemble(fit_rows, columns)
    side = regression.ridge_classifier(fit_rows, columns, label)
    out = regression.assemble(score_rows, columns).withColumn("ridge", (regression.predicted(side, columns) > 0).cast("int"))
    fitted = {
        "log_reg": logistic(label, train.count()).fit(fit_vectors),
        "bagging": bagged_trees(label, trees).fit(fit_vectors),
        "rf": random_forest(label, forest).fit(fit_vectors),
    }
    for name, model in fitted.items():
        out = model.transform(out).withColumn(name, F.col("prediction").cast("int")).drop("prediction", "rawPrediction", "probability")
    return add_votes(out.drop("features"), ["ridge", "log_reg", "bagging", "rf"])
