"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are column expressions. Shallow trees are grown on a bounded sample of labelled
rows; every path from a root becomes a rule, a conjunction of ranges. A lasso logistic
regression weighs the rules and drops most of them; what is left is one column expression,
so scoring needs neither a model object nor Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import crc_fold, materialize

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
SAMPLE_ROWS = 20_000  # most labelled rows that a model is fitted on
TREES, DEPTH, PENALTY = 24, 3, 0.001

STATISTICS = (
    "chars", "words", "distinct_words", "word_length", "upper", "symbols", "digits", "bare_words", "repeats", "lines",
    "distinct_lines", "line_length", "sentence_ends", "letters",
)


def statistics(text: Column) -> Column:
    """A struct of ``STATISTICS``; NULL and empty texts give zeros."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def counted(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    chars, upper, symbols, digits, letters = F.length(t), counted(r"\P{Lu}+"), counted(r"[\p{L}\p{N}\s]+"), counted(r"\P{N}+"), counted(r"\P{L}+")
    lines = F.split(t, "\n")
    base = F.struct(
        chars.cast("double").alias("chars"), words.alias("w"), lines.alias("l"), upper.alias("u"), symbols.alias("s"), digits.alias("d"), letters.alias("a"),
        F.regexp_count(t, F.lit(r"[.!?]")).alias("e"),
    )

    def finish(b: Column) -> Column:
        n, w, rows = b["chars"], b["w"], b["l"]
        size = F.size(w)
        again = F.aggregate(
            w, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
            lambda acc, x: F.struct(x.alias("last"), (acc["n"] + (acc["last"] == x).cast("int")).alias("n")),
        )["n"]
        values = {
            "chars": n, "words": size.cast("double"), "distinct_words": share(F.size(F.array_distinct(w)), size), "word_length": share(n, size),
            "upper": share(b["u"], n), "symbols": share(b["s"], n), "digits": share(b["d"], n),
            "bare_words": share(F.size(F.filter(w, lambda x: F.length(x) == 1)), size), "repeats": share(again, size), "lines": F.size(rows).cast("double"),
            "distinct_lines": share(F.size(F.array_distinct(rows)), F.size(rows)), "line_length": share(n, F.size(rows)),
            "sentence_ends": share(b["e"], size), "letters": share(b["a"], n),
        }
        return F.struct(*[values[k].alias(k) for k in STATISTICS])

    # One-element array: the parts are computed once and then read several times.
    return F.transform(F.array(base), finish)[0]


Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, up to), one range per statistic


def rules_of(tree_text: str) -> set[Rule]:
    """Every path from the root of a printed tree, as ranges."""
    found: set[Rule] = set()
    path: list[tuple[int, int, str, float]] = []
    for line in tree_text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, int(m[2]), m[3], float(m[4]))]
        ranges: dict[int, tuple[float, float]] = {}
        for _, k, sign, at in path:
            low, high = ranges.get(k, (-math.inf, math.inf))
            ranges[k] = (low, min(high, at)) if sign == "<=" else (max(low, at), high)
        found.add(tuple(sorted((k, a, b) for k, (a, b) in ranges.items())))
    return found


def condition(rule: Rule, values: Column) -> Column:
    out = F.lit(True)
    for k, low, high in rule:
        v = values[STATISTICS[k]]
        out = out & (v > low if low > -math.inf else F.lit(True)) & (v <= high if high < math.inf else F.lit(True))
    return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, values: Column) -> Column:
        """Probability of label 1, from a column made by ``statistics``."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(condition(rule, values), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold, picked by a hash of the id.

    Rows with a NULL id or label are not used; an id that repeats counts once. Without rows,
    or with one class, the model is the constant share of that class (0.5 without rows).
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_fold("doc_id", FOLDS) != HELD_OUT))
    picked = usable.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", statistics(F.col("text")).alias("x"))
    rows = materialize(texts.select("y", "x.*"), "quality-sample").coalesce(4)
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(seen) != {0.0, 1.0}:
        prior = min(max(next(iter(seen), 0.5), 0.01), 0.99)
        return RuleModel(math.log(prior / (1 - prior)), ())
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="v").transform(rows).cache()
    trees = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", seed=7).fit(data)
    rules = sorted(set().union(*(rules_of(t.toDebugString) for t in trees.trees)))
    packed = F.struct(*STATISTICS)
    flags = rows.select("y", F.array(*[condition(r, packed).cast("double") for r in rules]).alias("a"))
    from pyspark.ml.functions import array_to_vector

    flags = flags.select("y", array_to_vector("a").alias("v")).cache()
    lasso = LogisticRegression(featuresCol="v", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=200).fit(flags)
    data.unpersist()
    flags.unpersist()
    weights = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients) if abs(w) > 1e-9)
    return RuleModel(float(lasso.intercept), weights)


def scores(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. NULL texts count as empty."""
    held = crc_fold("doc_id", FOLDS) == HELD_OUT
    body = docs.select("doc_id", held.alias("held_out"), statistics(F.col("text")).alias("x"))
    scored = body.select("doc_id", "held_out", model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model accepts, with their columns."""
    name = "__x" + "_" * max(len(c) for c in docs.columns)  # no column has this name
    return docs.withColumn(name, statistics(F.col("text"))).where(model.score(F.col(name)) >= threshold).drop(name)
