"""The text classifier's rounds: all of them, and the same weights from arrays as from tables."""

import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA
from tidebook.catalog import models
from tidebook.models import text


@pytest.fixture(scope="module")
def docs(spark):
    words = F.expr("transform(sequence(0, 3 + id % 9), i -> concat('w', (id * 7 + i * i) % 23 % (5 + id % 3 * 9)))")
    rows = spark.range(120).select(F.when(F.col("id") % 40 > 0, F.col("id") % 100).alias("id"), F.when(F.col("id") % 37 > 0, F.concat_ws(" ", words)).alias("t"), F.expr("nullif(id % 4, 3)").cast("string").alias("c"))
    return rows.repartition(3)


def found(model, docs):
    weights = {(r.term, r["class"]): round(r.weight, 12) for r in model.table().collect()}
    return weights, [round(b, 12) for b in model.bias], sorted(model(docs, "id").select("id", "t", "predicted").collect(), key=repr)


def test_registered_classifier_runs_all_rounds(spark, monkeypatch):
    """As many rounds as the function's own default, in the query and in its SQL."""
    rounds = inspect.signature(text.fit_text_classifier).parameters["rounds"].default
    seen = []
    real = text.fit_text_classifier
    monkeypatch.setattr(text, "fit_text_classifier", lambda *args, **options: seen.append(options.get("rounds", rounds)) or real(*args, **options))
    assert entry.queries()["text_classifier"](spark, DATA).count() > 1
    assert seen == [rounds] == [30]
    assert all(f"u{rounds}" in entry.oracle_sql()[q] and f"u{rounds + 1}" not in entry.oracle_sql()[q] for q in ("text_classifier", "text_weights"))
    assert models.TEXT_ROUNDS == rounds


@pytest.mark.parametrize("limits", [{"MOST_HELD": 0}, {"MOST_HELD": 0, "MOST_SENT": 0}, {"BLOCK_DOCS": 3, "BLOCK_TERMS": 4}])
def test_arrays_and_tables_give_the_same_weights(docs, monkeypatch, limits):
    """Also with keys that are NULL or repeat and texts without terms."""
    want = found(text.fit_text_classifier(docs, "t", "c", "id", rounds=6), docs)
    for name, value in limits.items():
        monkeypatch.setattr(text, name, value)
    assert found(text.fit_text_classifier(docs, "t", "c", "id", rounds=6), docs) == want
    assert len(want[0]) > 30 and any(w for w in want[0].values())


def test_a_round_does_not_write_slopes_or_weights(docs, monkeypatch):
    """Rounds pass over stored cells; nothing that grows with the rows is stored by a round."""
    labels = []
    real = text.materialize
    monkeypatch.setattr(text, "materialize", lambda df, label, **options: labels.append(label) or real(df, label, **options))
    text.fit_text_classifier(docs, "t", "c", "id", rounds=5)
    assert sorted(labels) == ["cells", "idf", "terms", "text-model"]
