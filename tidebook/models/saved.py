"""Four classifiers that vote, fitted together and stored under a version, for scoring rows that come later."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.models import classifiers, logit, regression, trees
from tidebook.sources import sinks

VOTES = ["ridge", "log_reg", "bagging", "rf"]
PARTS = "part string, at int, body string"


@dataclass
class VoteModel:
    """What scoring needs: ranges of the training rows, categories, two lines and two forests."""

    numbers: list[str]
    ranges: list[tuple[float, float]]
    categories: dict[str, list[str]]
    ridge: list[float]  # weights, then the intercept
    logistic: list[float]
    bagging: trees.Forest
    forest: trees.Forest

    def features(self) -> list[str]:
        return _names(self.numbers, self.categories)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Numbers scaled by the training ranges (0 where they are a point) and a 0/1 column per category; an unseen one has zeros only."""
        return df.withColumns(_prepared(self.numbers, self.ranges, self.categories))

    def votes(self, df: DataFrame) -> DataFrame:
        """Adds one 0/1 column per model, their product ``vote`` and ``mean_vote``."""
        names = self.features()
        ready = self.prepare(df)
        ready = ready.withColumns({"ridge": (_line(names, self.ridge) > 0).cast("int"), "log_reg": (_line(names, self.logistic) > 0).cast("int")})
        ready = self.forest.predict(self.bagging.predict(ready, "bagging"), "rf")
        return classifiers.add_votes(ready.drop(*names), VOTES)

    def parts(self, spark: SparkSession) -> DataFrame:
        """The model as rows of text, one per range, category list, line and tree node. Numbers keep all their digits."""
        rows = [("number", i, json.dumps([n, *r])) for i, (n, r) in enumerate(zip(self.numbers, self.ranges))]
        rows += [("category", i, json.dumps([c, v])) for i, (c, v) in enumerate(self.categories.items())]
        rows += [("ridge", 0, json.dumps(self.ridge)), ("logistic", 0, json.dumps(self.logistic))]
        for name, f in (("bagging", self.bagging), ("forest", self.forest)):
            rows.append((name, -1, json.dumps([f.features, f.classes, f.trees, f.depth, f.key, f.seed])))
            rows += [(name, i, json.dumps(node)) for i, node in enumerate(f.nodes)]
        return spark.createDataFrame(rows, PARTS)

    def save(self, spark: SparkSession, path: str) -> int:
        """Store the model as the next version and return its number. It counts once it is committed."""
        number = max(versions(spark, path), default=0) + 1
        sinks.append_load(self.parts(spark), path, str(number))
        return number


def _names(numbers: Sequence[str], categories: dict[str, list[str]]) -> list[str]:
    return [f"__n{i}" for i in range(len(numbers))] + [f"__c{i}_{j}" for i, values in enumerate(categories.values()) for j in range(len(values))]


def _prepared(numbers: Sequence[str], ranges: Sequence[tuple[float, float]], categories: dict[str, list[str]]) -> dict[str, Column]:
    scaled = [(F.col(n).cast("double") - F.lit(lo)) / F.lit((hi - lo) or 1.0) for n, (lo, hi) in zip(numbers, ranges)]
    flags = [F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("double") for c, values in categories.items() for v in values]
    return dict(zip(_names(numbers, categories), [*scaled, *flags]))


def _line(names: Sequence[str], weights: Sequence[float]) -> Column:
    out = F.lit(weights[-1])
    for name, weight in zip(names, weights):
        out = out + F.lit(weight) * F.col(name)
    return out


def fit(
    train: DataFrame, numbers: Sequence[str], categories: Sequence[str], label: str, key: str, bagged: int = 10, forest: int = 20, depth: int = 6, most_values: int = 200,
) -> VoteModel:
    """Fit ridge, logistic regression, bagged trees and a random forest on rows scaled by their own ranges. ``label`` is 0 / 1, ``key`` unique."""
    known = train.dropna(subset=[*numbers, *categories, label])
    ends = known.agg(*[f(F.col(n).cast("double")) for n in numbers for f in (F.min, F.max)]).first()
    if ends[0] is None:
        raise ValueError("no complete training row")
    ranges = list(zip(ends[::2], ends[1::2]))
    values = {}
    for c in categories:
        values[c] = [r[0] for r in known.select(c).distinct().orderBy(c).limit(most_values + 1).collect()]
        if len(values[c]) > most_values:
            raise ValueError(f"{c} has more than {most_values} values")
    names = _names(numbers, values)
    rows = known.withColumns(_prepared(numbers, ranges, values))
    side = regression.ridge_classifier(rows, names, label)
    line = logit.fit(rows, names, label)
    grown = {"min_leaf": 4, "depth": depth, "sampled": True}
    return VoteModel(
        list(numbers), ranges, values, [*map(float, side.coefficients), float(side.intercept)], [*line.weights, line.intercept],
        trees.grow(rows, names, label, key, trees=bagged, seed=1, **grown),
        trees.grow(rows, names, label, key, trees=forest, seed=2, per_node=max(1, round(len(names) ** 0.5)), **grown))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return sorted(int(r[0]) for r in spark.read.schema(sinks.COMMITS).parquet(f"{path}/commits").select("load").distinct().collect())


def load(spark: SparkSession, path: str, version: int | None = None) -> VoteModel:
    """The model as it was saved: the given version or the newest."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise ValueError(f"no such version: {version}")
    rows = sinks.read_loads(spark, path, PARTS).where(F.col("load") == str(found[-1] if version is None else version)).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.part, r["at"])):
        by.setdefault(r.part, []).append(json.loads(r.body))

    def forest(part: str) -> trees.Forest:
        head, *nodes = by[part]
        return trees.Forest(*head, [tuple(n) for n in nodes])

    return VoteModel(
        [n for n, *_ in by["number"]], [(lo, hi) for _, lo, hi in by["number"]], dict(by.get("category", [])), by["ridge"][0], by["logistic"][0], forest("bagging"), forest("forest"))
