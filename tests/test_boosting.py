"""Boosted trees with a learned direction for missing values."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.operators import boosting, ml, summaries


def gaps(spark, n=900):
    """Heights are missing where the ground is soft: what is missing tells of the target."""
    rng = np.random.default_rng(5)
    soft = rng.random(n) < 0.35
    x, z = rng.uniform(0, 10, n), rng.uniform(-1, 1, n)
    y = np.where(soft, 30.0, x) + z + rng.normal(0, 0.3, n)
    rows = [(i % 90, None if s else float(a), float(b), "rock" if i % 3 else None, float(t)) for i, (s, a, b, t) in enumerate(zip(soft, x, z, y, strict=True))]
    return spark.createDataFrame(rows, "hole long, height double, z double, kind string, y double").repartition(3)


def test_informative_gaps_beat_median_filling(spark):
    df = gaps(spark)
    mine = boosting.out_of_fold(df, "y", ["height", "z"], ["kind"], "hole", 2, "s", trees=25, depth=3, rate=0.3)
    filled = ml.out_of_fold(df, "y", ["height", "z"], ["kind"], "hole", 2, "s", ml.boosted("y", trees=25, depth=3, rate=0.3))
    rmse = lambda out: summaries.regression_metrics(out, "y", "prediction").first().rmse
    assert mine.count() == 900 and mine.filter("prediction IS NULL").count() == 0
    assert mine.groupBy("hole").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    assert rmse(mine) < 1.0 < 3 * rmse(mine) < rmse(filled)


@pytest.mark.parametrize("seed", range(4))
def test_best_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    bins, y = rng.integers(0 if seed else 1, 5, (60, 3)), rng.normal(size=60)
    g, h = (np.array([[v[bins[:, f] == b].sum() for b in range(5)] for f in range(3)]) for v in (-y, np.ones(60)))
    found = boosting.best_split(g, h, 1.0, 5.0)
    score = lambda m: (-y[m]).sum() ** 2 / (m.sum() + 1)
    best = -np.inf
    for f, b, left in itertools.product(range(3), range(1, 5), (True, False)):
        m = np.where(bins[:, f] == 0, left, bins[:, f] <= b)
        if m.sum() >= 5 and (~m).sum() >= 5:
            best = max(best, score(m) + score(~m) - score(np.ones(60, bool)))
    assert found[0] == pytest.approx(best)
    m = np.where(bins[:, found[1]] == 0, found[3], bins[:, found[1]] <= found[2])
    assert score(m) + score(~m) - score(np.ones(60, bool)) == pytest.approx(best)


def test_one_tree_by_hand(spark):
    rows = [(1.0, 10.0, 1.0), (2.0, 10.0, 1.0), (3.0, 20.0, 1.0), (4.0, 20.0, 1.0), (None, 20.0, 1.0), (float("nan"), 20.0, 1.0), (9.0, None, 1.0), (9.0, 99.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    model = boosting.fit(df, "y", ["x"], trees=1, depth=1, rate=1.0, l2=0.0, weight="w")
    assert model.base == pytest.approx(100 / 6) and model.trees[0].missing_left[0] is False
    got = [r.prediction for r in model.predict(spark.createDataFrame([(0.0,), (2.0,), (3.0,), (50.0,), (None,)], "x double")).collect()]
    assert got == [pytest.approx(v) for v in (10, 10, 20, 20, 20)] and model.importance() == {"x": 1}


def test_trees_dont_depend_on_the_dealing_and_end_by_validation(spark, monkeypatch):
    df = gaps(spark, 400).withColumn("held", F.col("hole") % 4 == 0)
    options = {"trees": 60, "depth": 3, "rate": 0.5, "validation": "held", "patience": 4}
    one = boosting.fit(df.coalesce(1), "y", ["height", "z"], ["kind"], **options)
    monkeypatch.setattr(boosting, "BLOCK", 37)
    other = boosting.fit(df.repartition(5), "y", ["height", "z"], ["kind"], **options)
    assert 0 < len(one.trees) < 60 and len(one.trees) == len(other.trees) == int(np.argmin(one.losses))
    assert all((a.feature, a.threshold, a.missing_left) == (b.feature, b.threshold, b.missing_left) for a, b in zip(one.trees, other.trees, strict=True))
    held = one.predict(df.filter("held")).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert held == pytest.approx(min(one.losses))


def test_odd_frames(spark):
    df = gaps(spark, 60)
    assert boosting.fit(df.limit(0), "y", ["z"]).predict(df).agg(F.max("prediction")).first()[0] == 0.0
    assert boosting.fit(df, "y", []).trees == []
    nothing = df.withColumn("empty", F.lit(None).cast("double")).withColumn("same", F.lit("a"))
    model = boosting.fit(nothing, "y", ["empty"], ["same"], trees=3)
    assert model.trees == [] and model.predict(nothing.limit(0)).count() == 0
    unseen = boosting.fit(df, "y", ["height"], ["kind"], trees=2).predict(df.withColumn("kind", F.lit("never")))
    assert unseen.filter("prediction IS NULL OR isnan(prediction)").count() == 0
    with pytest.raises(ValueError, match="not a category"):
        boosting.fit(spark.range(2000).select(F.col("id").cast("string").alias("c"), F.lit(1.0).alias("y")), "y", [], ["c"])
