"""Grid scoring, estimators and comparisons on small frames."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geoledger.functions import columns as C
from geoledger.operators import graph, grid, joins, ml, scoring, splits, summaries
from geoledger.sources import sinks  # noqa: F401

AT = ((4, 5), 0.0, 0.0, 10.0)


def cells(spark, values):
    return spark.createDataFrame([(i, j, v) for i, row in enumerate(values) for j, v in enumerate(row)], "row long, col long, value int")


MASK = [[1, 1, 0, 0, 1], [0, 1, 1, 0, 0], [0, 0, 0, 0, 0], [1, 0, 0, 0, 1]]


def test_grid_job(spark):
    mask = cells(spark, MASK)
    places = [(10.0 * j, 10.0 * i) for i in range(4) for j in range(5)] + [(500.0, 0.0)]
    points = spark.createDataFrame(places, "x double, y double")
    predict = lambda p: p.withColumns({"wet": F.col("x") - 5, "dry": F.col("y")})
    found = scoring.score(points, mask, *AT, predict, ["wet", "dry"], 0.0, 30.0)
    rows = {(r.row, r.col): r for r in found.collect()}
    assert set(rows) == {(i, j) for i, row in enumerate(MASK) for j, v in enumerate(row) if v}
    assert rows[0, 0].wet == 0.0 and rows[0, 0].clipped_wet and rows[0, 4].wet == 30.0 and rows[3, 4].dry == 30.0 and not rows[3, 4].clipped_dry
    r = scoring.report(points, mask, found, *AT, ["wet", "dry"]).first()
    assert (r.active_cells, r.predicted_cells, r.missing_cells, r.outside_rows, r.masked_rows, r.dry_above_wet, r.status) == (7, 7, 0, 1, 13, 2, "complete")
    some = scoring.score(points.filter("x > 0"), mask, *AT, predict, ["wet"])
    r = scoring.report(points.filter("x > 0"), mask, some, *AT, ["wet"]).first()
    assert (r.missing_cells, r.status) == (2, "incomplete")
    assert scoring.report(points, mask, found, *AT, ["wet"], partial=True).first().status == "incomplete"
    none = scoring.report(points.limit(0), mask, found.limit(0), *AT, ["wet"]).first()
    assert (none.predicted_cells, none.status) == (0, "incomplete")


@pytest.mark.parametrize(("extra", "message"), [((0.0, 0.0), "two points"), ((11.0, 0.0), "not on the grid")])
def test_grid_job_refuses_bad_points(spark, extra, message):
    points = spark.createDataFrame([(0.0, 0.0), extra], "x double, y double")
    with pytest.raises(Exception, match=message):
        scoring.active_points(points, cells(spark, MASK), *AT).collect()


def test_grid_job_refuses_predictions_that_are_not_finite(spark):
    points = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0)], "x double, y double")
    with pytest.raises(Exception, match="not finite"):
        scoring.score(points, cells(spark, MASK), *AT, lambda p: p.withColumn("wet", F.when(F.col("x") > 0, 1.0)), ["wet"]).collect()


def test_score_chunks_goes_on_where_it_stopped(spark, tmp_path):
    points = spark.createDataFrame([(0.0, 0.0, 1), (10.0, 0.0, 1), (40.0, 0.0, 2)], "x double, y double, chunk int")
    path = f"{tmp_path}/out"
    predict = lambda v: lambda p: p.withColumn("wet", F.lit(v))
    scoring.score_chunks(points.filter("chunk = 1"), "chunk", cells(spark, MASK), *AT, predict(1.0), ["wet"], path)
    scoring.score_chunks(points, "chunk", cells(spark, MASK), *AT, predict(2.0), ["wet"], path)
    assert sorted((r.x, r.wet) for r in spark.read.option("header", True).csv(path).collect()) == [("0.0", "1.0"), ("10.0", "1.0"), ("40.0", "2.0")]


def test_display_cells_and_overlay(spark):
    scored = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6)], "row long, col long, wet double")
    assert {(r.row, r.col) for r in scoring.display_cells(scored, cells(spark, MASK), 2).collect()} == {(0, 0), (0, 4)}
    rows = [(0, 0, 4.5, 10.0), (0, 0, 5.5, 20.0), (1, 0, 5.0, 30.0), (1, 0, 4.0, 99.0), (2, 0, 7.0, 1.0), (3, 0, 5.0, None), (None, 0, 5.0, 1.0)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], "x double, y double, depth double, value double")
    found = {r.x: (r.value, r.samples, r.observed_depth) for r in scoring.overlay(df, 5.0, 1.0).collect()}
    assert found == {0.0: (15.0, 2, 5.0), 1.0: (30.0, 1, 5.0)}


def test_grid_shape():
    assert grid.grid_shape(-45800, 19000, 105400, 171200, 10) == (6581, 6481)
    with pytest.raises(ValueError):
        grid.grid_shape(0, 15, 0, 20, 10)


def test_locations_of_a_crowd(spark):
    """Thousands of holes in one cell, and a chain across cells: as brute force has it."""
    rng = random.Random(5)
    places = [(i, 100 + rng.random() * 4, 100 + rng.random() * 4) for i in range(3000)] + [(5000 + i, 9.0 * i, -50.0) for i in range(40)] + [(9000 + i, rng.uniform(0, 400), rng.uniform(200, 600)) for i in range(300)]
    found = {r.k: r.location for r in graph.location_groups(spark.createDataFrame(places, "k long, x double, y double"), 10.0, "k").collect()}
    assert len({found[i] for i in range(3000)}) == 1 and {found[5000 + i] for i in range(40)} == {5000}
    rest = [p for p in places if p[0] >= 9000]
    root = {k: k for k, _, _ in rest}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in rest:
        for b in rest:
            if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 10.0:
                low, high = sorted((find(a[0]), find(b[0])))
                root[high] = low
    assert {k: found[k] for k in root} == {k: find(k) for k in root}


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.999, 1.0])
def test_quantile_of_ties_and_nulls(spark, q):
    rng = random.Random(9)
    values = {"a": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(500)], "b": [rng.random() for _ in range(30000)], None: [3.0], "c": [-1.0, 5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    found = {r.k: (r.quantile, r.n) for r in summaries.quantile_higher(df, ["k"], "v", q).collect()}
    assert found == {k: (sorted(vs)[math.ceil((len(vs) - 1) * q)], len(vs)) for k, vs in values.items()}
    everything = sorted(v for vs in values.values() for v in vs)
    assert summaries.quantile_higher(df, [], "v", q).first()["quantile"] == everything[math.ceil((len(everything) - 1) * q)]


def test_balanced_folds(spark):
    rows = [(g, i) for g in range(200) for i in range(1 + (g * 7) % 5)]
    out = splits.balanced_folds(spark.createDataFrame(rows, "g long, i long"), "g", 4).collect()
    assert len(out) == len(rows) and len({(r.g, r.fold) for r in out}) == 200
    sizes = [sum(r.fold == k for r in out) for k in range(4)]
    assert max(sizes) - min(sizes) <= 5


def test_roles_and_folds_by_several_ids(spark):
    df = splits.group_folds(spark.createDataFrame([(i % 20, i) for i in range(100)], "g long, i long"), "g", 4, "s")
    roles = splits.inner_validation(df, "g", "fold", 1, "s").collect()
    assert len(roles) == 100 and len({(r.g, r.role) for r in roles}) == 20 and {r.role for r in roles} == {"test", "validation", "train"}
    assert all((r.role == "test") == (r.fold == 1) for r in roles)
    rows = [("a", None, 5.0, 5.0), ("b", "z", 15.0, 5.0), ("a", "q", 25.0, 5.0), ("c", "z", 35.0, 5.0), ("d", None, 45.0, 5.0), (None, None, 55.0, 5.0)]
    out = splits.spatial_folds_by_ids(spark.createDataFrame(rows, "one string, two string, x double, y double"), ["one", "two"], 10.0, 2, "s").collect()
    assert len(out) == 6
    group = {r.x: r.spatial_group for r in out}
    assert group[5.0] == group[25.0] and group[15.0] == group[35.0] and len(set(group.values())) == 4


def test_nearest_at_all(spark):
    rng = random.Random(3)
    a, b = ([(i, rng.uniform(0, 9000) ** 1.0, rng.uniform(0, 9000)) for i in range(n)] for n in (80, 12))
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, x double, y double")
    found = {r.q: (r.nearest_h, r.nearest_distance) for r in joins.nearest_at_all(df(a, "q"), df(b, "h"), 50.0, "q", "h").collect()}
    assert {q: (h, pytest.approx(d)) for q, (h, d) in found.items()} == {q: min((math.dist((x, y), p[1:]), p[0]) for p in b)[::-1] for q, x, y in a}
    assert joins.nearest_at_all(df(a, "q"), df(b, "h").limit(0), 50.0, "q", "h").filter("nearest_h IS NULL").count() == 80


def test_require_all_matched(spark):
    df = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert joins.require_all_matched(df(1, 2), df(1, 2, 3), ["k"]).count() == 2
    for bad in ((df(1, 4), df(1)), (df(1, 1), df(1)), (df(1), df(1, 1))):
        with pytest.raises(ValueError):
            joins.require_all_matched(*bad, ["k"])


def measured(spark, holes=40, depths=6):
    rng = random.Random(11)
    rows = []
    for h in range(holes):
        x, y = 100.0 * (h % 8), 100.0 * (h // 8)
        rows += [(f"{h}-{d}", f"h{h}", x, y, float(d), min(50.0, 3.0 * d + x / 50 + rng.random()), "abc"[h % 3]) for d in range(1, depths + 1)]
    return spark.createDataFrame(rows, "record_id string, boring_id string, x double, y double, depth double, n_value double, soil string")


def test_estimates_are_held_out(spark):
    spt = measured(spark)
    options = ml.Estimator(("x", "y", "depth"), seeds=(1, 2), trees=6, nearby=150.0, tolerance=1.0)
    frame = spt.filter("boring_id IN ('h0', 'h1', 'h2', 'h3')").drop("n_value", "soil")
    out = ml.crossfit_n(frame, spt, options, 2).collect()
    assert len(out) == frame.count() and len({(r.boring_id, r.fold) for r in out}) == 4
    assert all(r.n_nearest_hole_distance >= 100.0 and r.n_lower <= r.n_predicted <= r.n_upper for r in out)
    far = spark.createDataFrame([("q", 350.0, 1400.0, 99.0)], "record_id string, x double, y double, depth double")
    r = ml.estimate_n(spt, far, options).first()
    assert r.n_depth_extrapolation == 1 and r.n_nearby_hole_count == 0 and r.n_nearest_hole_distance > 900 and r.n_nearest_hole_depth_gap == 93.0


def test_final_fit_baselines_and_importance(spark):
    rows = measured(spark)
    fitted, trees = ml.final_fit(rows, "n_value", ["depth", "x"], ["soil"], "boring_id", 2, "f", trees=8, depth=3)
    assert 1 <= trees <= 8 and fitted.stages[-1].getNumTrees == trees
    frame = ml.feature_frame(rows.withColumn("empty", F.lit(1.0)), ["depth", "x"], ["soil"])
    table = {r.feature: r.contribution for r in ml.importance(fitted, fitted.transform(frame), ["depth", "x", "never"], ["soil"]).collect()}
    assert set(table) == {"depth", "x", "never", "soil"} and table["never"] == 0.0 and sum(table.values()) == pytest.approx(100) and table["depth"] > table["soil"] < table["x"]
    told = ml.baselines(rows.filter("x < 500"), rows.filter("x >= 500"), "n_value").collect()
    assert len({r.baseline_median for r in told}) == 1 and all(math.isfinite(r.baseline_place) for r in told)
    out = ml.predict(rows, fitted, ["depth", "x"], ["soil"])
    assert ml.final_diagnostics(out, "n_value", "prediction").first().r2 > 0.8
    for bad in (out.withColumn("prediction", F.lit(float("nan"))), out):
        with pytest.raises(ValueError):
            ml.final_diagnostics(bad.withColumn("label_source", F.lit("predicted")), "n_value", "prediction", "label_source")


def test_failing_models_are_left_out(spark):
    dealt = splits.group_folds(measured(spark), "boring_id", 2, "c")
    half = lambda train, test, *_: test.filter("x < 300").withColumn("prediction", F.lit(1.0))
    oof, scores, failures = ml.compare_models(dealt, "n_value", ["depth", "x"], [], {"good": ml.fitted_with(ml.linear("n_value")), "half": half, "broken": lambda *_: 1 / 0}, "record_id", 2)
    assert {r.model for r in scores.collect()} == {"good"} and set(failures) == {"half", "broken"} and oof.count() == dealt.count()
    assert {r.population for r in scores.collect()} == {"fold_0", "fold_1", "OOF"}
    assert ml.compare_models(dealt, "n_value", ["depth"], [], {"broken": lambda *_: 1 / 0}, "record_id", 2)[0] is None
    deltas = ml.ablation(dealt, "n_value", {"depth": (["depth"], []), "both": (["depth", "x"], [])}, "record_id", 2, "depth", ml.linear("n_value")).collect()
    assert all(r.rmse_delta < 0 for r in deltas if r.scenario == "both") and all(r.rmse_delta == 0 for r in deltas if r.scenario == "depth")


def test_most_frequent_fill(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert [r.c for r in ml.fill_most_frequent(df, df.filter("c IS NULL"), ["c"]).collect()] == ["a"]
    assert [r.c for r in ml.fill_most_frequent(df.limit(0), df.filter("c IS NULL"), ["c"]).collect()] == ["UNKNOWN"]


def test_texts_and_names(spark):
    df = spark.createDataFrame([("1,200 kPa",), ("砂質",), ("-",), (None,), ("a/b:c*",), ("..",)], "t string")
    n, text = C.number_or_text(F.col("t"))
    assert [(r.n, r.x) for r in df.select(n.alias("n"), text.alias("x")).collect()][:4] == [(1200.0, None), (None, "砂質"), (None, None), (None, None)]
    assert [r.f for r in df.select(C.file_name(F.col("t")).alias("f")).collect()][3:] == ["unnamed", "a_b_c_", "unnamed"]


def test_summaries_of_empty_tables(spark):
    empty = measured(spark).limit(0)
    assert summaries.distribution(empty, ["soil"], "n_value").count() == 0 and summaries.value_counts(empty, "soil").count() == 0
    assert summaries.composition(empty, ["x", "y"]).first().rows == 0 and summaries.mesh_prefixes(empty, "x", "y").count() == 0
    assert summaries.quantile_higher(empty, ["soil"], "n_value", 0.9).count() == 0
