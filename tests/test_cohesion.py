"""The cohesion workflow on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from geoledger.operators import cohesion, ml, summaries


def samples(spark, holes=30):
    k = F.col("id") % holes
    return spark.range(holes * 2).select(F.col("id").cast("string").alias("record_id"), k.cast("string").alias("boring_id"), (k * 40.0).alias("x"), (k % 7 * 30.0).alias("y"), (1 + F.col("id") % 5).cast("double").alias("depth"), (k % 7 * 3.0 + F.col("id") % 5).alias("target"), F.when(k % 3 != 0, k % 11 * 2.0).alias("n_measured"))


def test_prepare_says_why_records_are_left_out(spark):
    rows = [("1", "s", 2.0, 10.0), ("2", "s", 2.0, 10.0), ("3", "t", 2.0, None), ("4", "u", 30.0, 10.0), ("5", None, 2.0, 10.0), ("6", None, 2.0, 10.0), ("7", "v", None, 9.0)]
    df = spark.createDataFrame(rows, "record_id string, sample string, depth double, surface_z double")
    kept, left = cohesion.prepare(df, ["sample", "depth"], 1.0, 20.0)
    assert sorted((r.record_id, r.sample_elevation) for r in kept.collect()) == [("1", 8.0), ("5", 8.0)]
    assert sorted((r.record_id, r.exclusion_reason) for r in left.collect()) == [("2", "duplicate"), ("3", "outside_dem"), ("4", "outside_training_depth_range"), ("6", "duplicate"), ("7", "outside_training_depth_range")]


def test_grid_of_cohesion_without_counts(spark, tmp_path):
    data = samples(spark)
    points = spark.range(12).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 4 * 10.0).alias("x"), (F.floor(F.col("id") / 4) * 10.0).alias("y"), F.lit(2.0).alias("depth"))
    mask = spark.range(12).select(F.floor(F.col("id") / 4).alias("row"), (F.col("id") % 4).alias("col"), F.when(F.col("id") == 5, 0).otherwise(1).alias("value"))
    set_up = cohesion.Settings(["x", "y", "depth"], trees=4)
    comparison, final, report = cohesion.distribute(data, points, mask, (3, 4), 0.0, 0.0, 10.0, set_up, path=f"{tmp_path}/c")
    assert [(r.scenario, r.status) for r in comparison.collect()] == [("predicted_n", "evaluated")]
    assert final.first()["n"] == data.count()
    r = report.first()
    assert (r.active_cells, r.predicted_cells, r.masked_rows, r.status) == (11, 11, 1, "complete") and r.c_least >= 0
    assert spark.read.parquet(f"{tmp_path}/c").count() == 11


def test_comparison_with_measured_counts(spark, monkeypatch):
    """The estimator has tests of its own; here its place is taken by a plain rule."""
    data = samples(spark)
    few = data.withColumn("n_measured", F.when(F.col("boring_id").isin("1", "2"), F.lit(5.0)))
    monkeypatch.setattr(ml, "evaluation_n", lambda train, heldout, *_: tuple(d.withColumn("n_predicted", F.col("depth") * 2) for d in (train, heldout)))
    set_up = cohesion.Settings(["depth", "n_value"], estimator=ml.Estimator(("depth",)), folds=2, trees=2)
    got, trees = cohesion.compare(data, set_up)
    got = {r.scenario: r for r in got.collect()}
    assert set(got) == set(cohesion.SCENARIOS) and {r.status for r in got.values()} == {"evaluated"} and got["predicted_n"].n == got["measured_n"].n and trees >= 1
    got = {r.scenario: r for r in cohesion.compare(few, set_up)[0].collect()}
    assert got["measured_n"].status == "unavailable" and got["measured_n"].reason.startswith("measured counts of 2 holes") and got["predicted_n"].status == "evaluated"
    with pytest.raises(ValueError):
        cohesion.evaluate(data.withColumn("split", F.lit("train")), set_up, "measured_n")


def test_a_split_without_rows_falls_back_to_estimates(spark, monkeypatch):
    """Five holes with measured counts, one row each: some split has one row, and all rows are evaluated with estimates."""
    data = samples(spark)
    five = data.withColumn("n_measured", F.when(F.col("record_id").isin("1", "2", "3", "4", "5"), F.lit(5.0)))
    monkeypatch.setattr(ml, "evaluation_n", lambda train, heldout, *_: tuple(d.withColumn("n_predicted", F.col("depth") * 2) for d in (train, heldout)))
    got = {r.scenario: r for r in cohesion.compare(five, cohesion.Settings(["depth", "n_value"], estimator=ml.Estimator(("depth",)), folds=2, trees=2))[0].collect()}
    assert got["measured_n"].status == "unavailable" and "fewer than two rows" in got["measured_n"].reason and got["predicted_n"].status == "evaluated"


def test_a_place_has_one_name(spark):
    rows = [("b", 1.0, 1.0), ("a", 1.0, 1.004), ("c", 9.0, 9.0), ("d", None, 1.0), ("b", 1.0, 1.0)]
    got = cohesion.located(spark.createDataFrame(rows, "boring_id string, x double, y double")).collect()
    assert sorted((r.source_boring_id, r.boring_id) for r in got) == [("a", "a"), ("b", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


def test_one_member_has_no_deviation(spark):
    r = summaries.ensemble(spark.createDataFrame([(3.0,)], "a double"), ["a"], F.lit(1.0), 0.0, 50.0).first()
    assert (r.prediction, r.deviation, r.lower, r.upper) == (3.0, None, 2.0, 4.0)
