import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import percentiles, windows
from tidebook.operators.aggregates import box_stats, histogram

QS = [0.0, 0.25, 0.5, 0.8, 0.975, 1.0]


def frame(spark, groups):
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    data += [("empty", None), (None, 4.0), (None, 6.0)]
    return spark.createDataFrame(data, "g string, v double").repartition(6)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    return {
        "hot": rng.lognormal(0, 3, 6000),
        "ties": rng.integers(0, 5, 2000),
        "constant": np.full(500, 2.5),
        "small": [3.0, 1.0],
        "one": [9.0],
    }


@pytest.mark.parametrize("marks, accuracy, rows_per_range, groups_sent", [(400, 10_000, 2_000_000, 20_000), (20, 100, 50, 20_000), (5, 60, 300, 1), (1, 100, 100, 0)])
def test_exact_percentiles(spark, groups, monkeypatch, marks, accuracy, rows_per_range, groups_sent):
    # Coarse sketches, many ranges, joined brackets: the same numbers each time.
    monkeypatch.setattr(percentiles, "MARKS", marks)
    monkeypatch.setattr(percentiles, "ACCURACY", accuracy)
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", rows_per_range)
    monkeypatch.setattr(percentiles, "BROADCAST_GROUPS", groups_sent)
    got = {r.g: list(r)[1:] for r in percentiles.exact_percentiles(frame(spark, groups), ["g"], "v", QS).collect()}
    assert set(got) == {*groups, None}
    for g, values in [*groups.items(), (None, [4.0, 6.0])]:
        np.testing.assert_allclose(got[g], np.percentile(values, [100 * q for q in QS]), rtol=1e-12)


def test_without_keys(spark, groups):
    df = frame(spark, {"hot": groups["hot"]}).where("g = 'hot'")
    assert percentiles.exact_percentiles(df, [], "v", [0.975]).first()[0] == pytest.approx(np.percentile(groups["hot"], 97.5))


def test_infinite_values(spark):
    values = [1.0, 2.0, math.inf, math.inf, math.inf]
    got = percentiles.exact_percentiles(frame(spark, {"a": values}).where("g = 'a'"), [], "v", [0.25, 0.9]).first()
    assert list(got) == [2.0, math.inf]


def test_approx_rank_error(spark, groups):
    got = {r.g: r.p0 for r in percentiles.approx_percentiles(frame(spark, groups), ["g"], "v", [0.8], accuracy=100).collect()}
    hot = np.sort(groups["hot"])
    rank = np.searchsorted(hot, got["hot"], side="right") / len(hot)
    assert abs(rank - 0.8) <= 0.011


def test_box_stats(spark, groups):
    got = box_stats(frame(spark, groups), "v", ["g"]).where("g = 'hot'").first()
    q1, med, q3 = np.percentile(groups["hot"], [25, 50, 75])
    out = sum((groups["hot"] < q1 - 1.5 * (q3 - q1)) | (groups["hot"] > q3 + 1.5 * (q3 - q1)))
    assert (got.q1, got["median"], got.q3, got.outliers) == (pytest.approx(q1), pytest.approx(med), pytest.approx(q3), out)


def test_histogram_sums_to_the_non_null_count(spark, groups):
    df = frame(spark, groups)
    assert histogram(df, "v", 10, ["g"]).agg(F.sum("cnt")).first()[0] == df.where("v IS NOT NULL").count()
    want, _ = np.histogram(groups["hot"], bins=20)
    got = {r.bin: r.cnt for r in histogram(df.where("g = 'hot'"), "v", 20).collect()}
    assert [got.get(i, 0) for i in range(20)] == list(want)


def test_histogram_leaves_out_nan(spark):
    got = histogram(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (float("inf"),), (None,)], "v double"), "v", 2).collect()
    assert sorted((r.bin, r.cnt) for r in got) == [(0, 1), (1, 1)]


def test_histogram_of_a_constant(spark):
    got = histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 10).collect()
    assert [(r.bin, r.cnt) for r in got] == [(0, 4)]


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 90.0), (None, 3.0), (None, 2.5), ("a", 1.0)], "g string, v double")
    got = {r.g: r.outliers for r in box_stats(df, "v", ["g"]).collect()}
    assert got == {None: 1, "a": 0}
