"""Scenario experiments: shared models, common test rows, weights; teachers that never see held-out labels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.operators import scenarios, splits
from geoledger.storage import written

FAST = {"depth": 2, "rate": 0.5, "bins": 16}


def learner(calls):
    def run(training, tuning, target, numeric, categorical, weight=None, trees=4):
        calls.append({"rows": training.count(), "features": list(numeric), "weight": weight, "tuned": tuning is not None, "trees": trees, "weights": sorted(r[0] for r in training.select(weight).distinct().collect()) if weight else None})
        return scenarios.boosted(training, tuning, target, numeric, categorical, weight, trees, **FAST)

    return run


def gamma(spark, n=240):
    rng = np.random.default_rng(1)
    x, blows = rng.uniform(0, 10, n), rng.uniform(0, 50, n)
    y = 15 + 0.1 * blows + 0.05 * x
    rows = [(i, i // 4, float(a), float(b) if i % 4 else None, float(b + rng.normal(0, 4)), float(t) if i % 19 else None) for i, (a, b, t) in enumerate(zip(x, blows, y, strict=True))]
    df = spark.createDataFrame(rows, "record_id long, boring_id long, x double, n_measured double, n_predicted double, gamma double")
    extra = {c: F.rand(3) for c in scenarios.RELIABILITY}
    return splits.group_split(df.withColumns({"n_lower": F.col("n_predicted") - 8, "n_upper": F.col("n_predicted") + 8, **extra}), "boring_id", "s")


def test_scenarios_share_test_rows_and_a_model(spark):
    df, calls = gamma(spark), []
    df = written(df, "gamma")
    train, tuning, test = (df.filter(F.col("split") == k) for k in ("train", "validation", "test"))
    scores, predictions, estimates = scenarios.blow_count_scenarios(train, tuning, test, "gamma", ["x"], [], "record_id", "boring_id", learner=learner(calls))
    got = {r.scenario: r for r in scores.collect()}
    assert set(got) == set(scenarios.SCENARIOS) and len(calls) == 6 and got["measured_to_predicted_n"].model == "measured_n"
    common = test.filter("gamma IS NOT NULL AND n_measured IS NOT NULL")
    ids = {r.record_id for r in common.collect()}
    for name in scenarios.SCENARIOS:
        assert {r.record_id for r in predictions.filter(F.col("scenario") == name).collect()} == ids and got[name].n == len(ids)
    usable = train.filter("gamma IS NOT NULL")
    own = usable.filter("n_measured IS NOT NULL").count()
    assert got["no_n"].training_rows == got["no_n"].primary_rows == own
    assert (got["measured_plus_supplemental"].training_rows, got["measured_plus_supplemental"].supplemental_rows) == (usable.count(), usable.count() - own)
    weighted = [c for c in calls if c["weight"]]
    assert len(weighted) == 2 and all(c["weights"] == [0.5, 1.0] for c in weighted)
    assert [c["features"] for c in calls if len(c["features"]) > 2] == [["x", "n_value", *scenarios.RELIABILITY]]
    assert got["measured_n"].rmse < got["measured_to_predicted_n"].rmse and got["measured_n"].rmse < 0.6 * got["no_n"].rmse
    e = estimates.first()
    assert e.n == len(ids) and 0.8 < e.interval_coverage <= 1 and e.mean_interval_width == pytest.approx(16)


def test_too_little_data_and_unknown_scenarios_are_refused(spark):
    df = written(gamma(spark, 80), "gamma")
    train, tuning, test = (df.filter(F.col("split") == k) for k in ("train", "validation", "test"))
    args = ("gamma", ["x"], [], "record_id", "boring_id")
    for parts in ((train.limit(1), tuning, test), (train, tuning.limit(0), test), (train, tuning, test.filter("n_measured IS NULL")), (train.filter(F.col("boring_id") == train.first().boring_id), tuning, test)):
        with pytest.raises(scenarios.InsufficientData):
            scenarios.blow_count_scenarios(*parts, *args)
    with pytest.raises(ValueError, match="unknown scenarios: all"):
        scenarios.blow_count_scenarios(train, tuning, test, *args, scenarios=["all"])


def stages(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        a, b, c = rng.uniform(0, 10, 3)
        rows.append((i, i // 4, float(i // 4), 1.0, float(a), float(b) if i % 3 else None, float(c) if i % 5 else None, float(2 * a + (b if i % 3 else 0))))
    measured = spark.createDataFrame(rows, "record_id long, boring_id long, x double, y double, a double, b double, c double, t double")
    others = [(1000 + i, r[1] if i < 20 else 500 + i, r[2] if i < 40 else 900.0 + i, 1.0, r[4], r[5], r[6], -999.0) for i, r in enumerate(rows[:100])]
    return measured, spark.createDataFrame(others, measured.schema)


def test_candidates_go_to_the_first_teacher_that_can_tell(spark):
    _, candidates = stages(spark)
    got = {r.record_id: r for r in scenarios.route(candidates, {"D": ["a", "b", "c"], "C": ["a", "b"], "B": ["a"]}).collect()}
    assert all(r.source_model == ("B" if r.b is None else "C" if r.c is None else "D") for r in got.values()) and {r.source_model for r in got.values()} == {"B", "C", "D"}


def test_teachers_never_see_heldout_labels(spark):
    measured, candidates = stages(spark)
    calls = []
    scores, summary, trees = scenarios.two_stages(measured, candidates, "t", ["a", "b"], [], {"C": ["a", "b"], "B": ["a"]}, "record_id", "boring_id", [1, 2], learner=learner(calls))
    got = {(r.seed, r.student): r for r in scores.collect()}
    assert set(got) == {(s, k) for s in (1, 2) for k in ("measured_only", "augmented")} and len(calls) == 2 * (2 * 2 + 2)
    for seed in (1, 2):
        split = splits.group_split(measured, "boring_id", f"two-stages-{seed}").toPandas()
        heldout = split[split.split != "train"]
        safe = [r for r in candidates.collect() if r.boring_id not in set(heldout.boring_id) and (r.x, r.y) not in set(zip(heldout.x, heldout.y, strict=True))]
        one, other = got[seed, "measured_only"], got[seed, "augmented"]
        assert (one.training_rows, one.predicted_rows, one.overlap) == ((split.split == "train").sum(), 0, 0)
        assert (other.measured_rows, other.predicted_rows) == (one.training_rows, len(safe)) and 0 < len(safe) < 100
        assert one.n == other.n == (split.split == "test").sum()
    # the labels that candidates came with (-999) would have ruined this
    assert all(r.rmse < 3 for r in got.values())
    assert {r.student for r in summary.collect()} == {"measured_only", "augmented"} and trees >= 1
    # teachers are tuned on a part of the training groups, then fitted again with the tree count found and no tuning rows
    assert [c["tuned"] for c in calls[:4]] == [True, False, True, False] and calls[1]["rows"] > calls[0]["rows"] and 1 <= calls[1]["trees"] <= 4


def test_targets_are_no_features_and_ids_are_unique(spark):
    measured, candidates = stages(spark)
    args = ("t", ["a"], [], {"B": ["a"]}, "record_id", "boring_id", [1])
    with pytest.raises(ValueError, match="not features: t"):
        scenarios.two_stages(measured, candidates, "t", ["a", "t"], [], {"B": ["a"]}, "record_id", "boring_id", [1])
    with pytest.raises(ValueError, match="not unique"):
        scenarios.two_stages(measured, measured, *args)
    with pytest.raises(scenarios.InsufficientData, match="teacher C"):
        scenarios.two_stages(measured.withColumn("c", F.lit(None).cast("double")), candidates, "t", ["a"], [], {"C": ["c"], "B": ["a"]}, "record_id", "boring_id", [1])
