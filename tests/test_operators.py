"""The operators on tiny literal frames."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from geoledger.functions import columns as C
from geoledger.operators import graph, grid, joins, ledger, matching, ml, reshape, spatial, splits, summaries


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_depth_range_is_inclusive_and_finite(spark):
    df = spark.createDataFrame([(k, d) for k, d in zip("abcdefg", [0.0, 10.0, 20.0, 20.01, math.nan, -1.0, math.inf], strict=True)], "k string, depth double")
    assert [r.k for r in df.filter(C.in_range(F.col("depth"), None, 20)).orderBy("k").collect()] == ["a", "b", "c"]
    assert [r.k for r in df.filter(C.in_range(F.col("depth"), 10, 20)).orderBy("k").collect()] == ["b", "c"]


@pytest.mark.parametrize(("text", "want"), [("1,234.5 kPa", 1234.5), (" -2e1 ", -20.0), ("n/a", None), ("欠測", None), ("", None), ("abc", None), ("-", None), ("about 7 m", 7.0), (None, None)])
def test_safe_number(spark, text, want):
    assert value(spark, C.safe_number(F.lit(text).cast("string"))) == want


def test_other_columns(spark):
    assert value(spark, C.upper_cap(F.lit(None).cast("double"))) is None and value(spark, C.upper_cap(F.lit(60.0))) == 50.0
    assert value(spark, C.phi_from_n(F.lit(15.0))) == 30.0 and value(spark, C.phi_from_n(F.lit(1e6))) == 40.0
    wet, dry = C.unit_weights(F.lit(1.0), F.lit(2.0))
    assert value(spark, wet) is None and value(spark, dry) is None
    assert value(spark, C.decimal_degrees(F.lit("-35度30分36秒"))) == pytest.approx(-35.51)
    assert value(spark, C.meshcode_250m(F.lit(139.745), F.lit(35.658))) == "5339358943"
    assert value(spark, C.meshcode_250m(F.lit(99.0), F.lit(35.0))) is None
    assert value(spark, C.local_name(F.lit("{urn:a}p:Name"))) == "Name" and value(spark, C.normalized(F.lit("Se an_-:/（x）")) ) == "seanx"
    assert value(spark, C.code_text(F.lit(3.0))) == "3" and value(spark, C.code_text(F.lit(None).cast("double"))) == "UNKNOWN"


def test_reasons_first_rule_wins(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, None, 1.0), (3, None, None), (4, -1.0, 1.0), (5, 1.0, -1.0)], "id int, depth double, n_value double")
    good, bad = ledger.split(df, reshape.measurement_rules())
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.exclusion_reason for r in bad.collect()} == {2: "one_missing", 3: "both_missing", 4: "depth_not_positive", 5: "negative_value"}
    assert {r.metric: r.value for r in ledger.reason_counts(df, reshape.measurement_rules()).collect()}["input_rows"] == 5


def test_assertions_raise(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(ValueError, match="not unique"):
        ledger.assert_unique(df, ["a"])
    with pytest.raises(ValueError, match="missing columns: c"):
        ledger.require_columns(df, ["a", "c"])
    with pytest.raises(ValueError, match="not unique"):
        joins.validated_join(df, df, ["a"])


def test_wide_to_long(spark):
    names = reshape.pair_names(2)
    df = spark.createDataFrame([("h", "1", "x", "2", "7")], ["id", *(n for p in names for n in p)])
    assert [tuple(r) for r in reshape.wide_to_long(df, "id", names).collect()] == [("h", 1, 1.0, None), ("h", 2, 2.0, 7.0)]


def test_effective_cohesion_rules(spark):
    rows = [("B0523", "", 0.0, None, 1.0), ("", "CD", None, 12.0, 2.0), ("B0521", "CUb", 1.0, None, 1.0), ("B0524", "", 1.0, 5.0, 1.0), ("B0524", "", -1.0, None, 1.0), ("B0524", "", 3.0, 3.0, None)]
    df = spark.createDataFrame(rows, "test_condition_code string, test_type string, c_effective double, shear_strength_effective double, depth_mid double")
    out = reshape.effective_cohesion(df).collect()
    assert [r.target for r in out if not r.exclusion_reason] == [0.0, 12.0]
    assert [r.exclusion_reason for r in out[2:]] == ["not_CUb_or_CD", "conflicting_effective_cohesion_fields", "missing_or_invalid_effective_cohesion", "invalid_depth"]


def test_density_records(spark):
    rows = [(1.8, None, 1.0, 1.0, 1.0, 1.0), (None, 10.0, 0.0, 100.0, 5.0, 5.0), (None, 10.0, None, 1.0, 1.0, 1.0), (None, -1.0, 1.0, 1.0, 1.0, 1.0), (0.0, 5.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "wet_density double, water_content double, gravel_fraction double, sand_fraction double, silt_fraction double, clay_fraction double")
    out = reshape.density_record(df).collect()
    assert [r.measured for r in out] == [True, False, False, False, False] and [r.candidate for r in out] == [False, True, False, False, False]


def square(i, code, x0, x1):
    return (i, code, [[(x0, 0.0), (x1, 0.0), (x1, 2.0), (x0, 2.0)]])


POLYGONS = "poly_id long, code string, rings array<array<struct<x:double,y:double>>>"


def test_points_in_polygons(spark):
    polygons = spark.createDataFrame([square(0, "A", 0.0, 2.0), square(1, "B", 1.0, 3.0), square(2, "A", 0.0, 1.0)], POLYGONS)
    points = spark.createDataFrame([(0, 0.5, 1.0), (1, 1.5, 1.0), (2, 4.0, 1.0), (3, 0.0, 1.0)], "point_id long, x double, y double")
    assert [r.code for r in spatial.agreed_code(points, polygons, 1.0).orderBy("point_id").collect()] == ["A", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    first = {r.point_id: (r.poly_id, r.match_method) for r in spatial.first_match(points, polygons, 0.7, fallback=True).collect()}
    assert first == {0: (0, "within"), 1: (0, "within"), 2: (None, "unmatched"), 3: (0, "intersects")}


def test_polygon_with_a_hole(spark):
    ring = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]
    polygons = spark.createDataFrame([(0, "A", ring)], POLYGONS)
    points = spark.createDataFrame([(0, 2.0, 2.0), (1, 0.5, 2.0), (2, 1.0, 2.0)], "point_id long, x double, y double")
    assert [r.match_method for r in spatial.first_match(points, polygons, 1.0).orderBy("point_id").collect()] == ["unmatched", "within", "unmatched"]
    assert polygons.select(spatial.ring_area(F.col("rings")[0]).alias("a")).first().a == 16.0


def test_interval_match(spark):
    m = spark.createDataFrame([("a", 0.0, 0.0, d, n, i) for i, (d, n) in enumerate([(1.0, 10.0), (2.0, 20.0), (2.5, 20.0), (4.0, 40.0)])] + [("b", 9.0, 9.0, 1.0, 1.0, 0), ("c", 9.0, 9.005, 1.0, 1.0, 0)], "hole_id string, x double, y double, depth double, n_value double, measurement_no int")
    rows = [(1, 0.0, 0.0, 2.0, 1.5, 2.6), (2, 0.0, 0.0, 3.5, 3.0, 3.8), (3, 9.0, 9.0, 1.0, None, None), (4, 5.0, 5.0, 1.0, None, None), (5, 0.0, 0.0, 4.0, None, None), (6, 0.0, 0.0, 1.0, 3.0, 2.0)]
    out = {r.sample_id: r for r in matching.match_intervals(spark.createDataFrame(rows, "sample_id int, x double, y double, depth double, depth_top double, depth_bottom double"), m, 0.01, 1e-6).collect()}
    assert [out[i].n_match_method for i in range(1, 7)] == ["interval_mean", "no_spt_in_interval", "ambiguous_hole", "no_matching_hole", "exact_depth_mean", "invalid_sample_interval"]
    assert out[1].n_measured == 20 and out[1].spt_count == 2 and out[1].spt_max_depth_difference == 0.5 and out[2].n_measured is None and out[2].nearest_depth == 4.0


def test_exclusions(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("a2", 0.0, 0.0, 2.0), ("b", 0.005, 0.0, 1.0), ("c", 5.0, 5.0, 1.0)], "boring_id string, x double, y double, depth double")
    held = spark.createDataFrame([("a", 0.0, 0.0)], "boring_id string, x double, y double")
    assert sorted(r.boring_id for r in joins.exclude_heldout(rows, held).collect()) == ["b", "c"]
    assert sorted(r.boring_id for r in joins.exclude_near(rows, held, 0.01).collect()) == ["c"]
    assert joins.exclude_near(rows, held.limit(0), 0.01).count() == 4


def test_nearest_in_window(spark):
    rows = [(0, 4.0, 10.0), (0, 6.0, 20.0), (1, 4.5, 40.0), (1, 6.0, 99.0), (2, 6.0, 50.0), (3, 6.5, 1.0)]
    df = spark.createDataFrame(rows, "x int, depth double, value double")
    out = {r.x: (r.value, r.samples) for r in joins.select_nearest(df, ["x"], F.col("depth"), 5.0, 1.0, "value").collect()}
    assert out == {0: (15.0, 2), 1: (40.0, 1), 2: (50.0, 1)}


def test_metrics_and_ensemble(spark):
    m = summaries.regression_metrics(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "a double, p double"), "a", "p").first()
    assert (m.bias, m.rmse, m.mae, m.r2) == (1.0, 1.0, 1.0, pytest.approx(-0.5))
    e = summaries.ensemble(spark.createDataFrame([(10.0, 20.0, 30.0)], "a double, b double, c double"), ["a", "b", "c"], F.lit(4.0), 0.0, 50.0).first()
    assert (e.prediction, e.lower, e.upper, e.deviation) == (20.0, 16.0, 24.0, 10.0)
    q = summaries.quantile_higher(spark.range(10).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v")), ["k"], "v", 0.9).first()
    assert q["quantile"] == 9.0


def test_histogram_of_a_constant(spark):
    out = summaries.histogram(spark.createDataFrame([(5.0,), (5.0,), (math.nan,)], "v double"), "v").collect()
    assert len(out) == 20 and sum(r.n for r in out) == 2 and out[0].n_excluded == 1 and min(r.lower for r in out) == 4.5


def test_splits_never_divide_a_group(spark):
    df = spark.range(180).select((F.col("id") % 60).alias("boring_id"), "id")
    for out, column in ((splits.group_split(df, "boring_id", "s"), "split"), (splits.group_folds(df, "boring_id", 5, "s"), "fold"), (splits.balanced_folds(df, "boring_id", 4), "fold")):
        splits.assert_disjoint(out, "boring_id", column)
        assert out.count() == 180
    counts = {r.split: r["count"] for r in splits.group_split(df, "boring_id", "s").groupBy("split").count().collect()}
    assert counts == {"test": 36, "validation": 36, "train": 108}


def test_spatial_folds_keep_holes_and_blocks_whole(spark):
    rows = [(i, f"h{i // 2}", float(10000 * (i % 20)) + 1, 1.0) for i in range(40)] + [(40, "h0", 150001.0, 1.0)]
    out = splits.spatial_block_folds(spark.createDataFrame(rows, "row_id int, boring_id string, x double, y double"), "boring_id", 10000.0, 3, "s")
    splits.assert_disjoint(out, "boring_id", "fold")
    splits.assert_disjoint(out, "block", "fold")
    assert out.count() == 41


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_locations(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.005, 0.0), ("c", 0.012, 0.0), ("d", 1.0, 1.0)], "boring_id string, x double, y double")
    assert {r.boring_id: r.location for r in graph.location_groups(df, 0.01).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_terrain_of_a_plane(spark):
    dem = spark.createDataFrame([(r, c, 2.0 * c + 10) for r in range(5) for c in range(5)], "row long, col long, value double")
    points = spark.createDataFrame([(0, 15.0, 15.0), (1, 0.0, 0.0), (2, 99.0, 0.0)], "point_id long, x double, y double")
    out = {r.point_id: r for r in grid.terrain_at(points, dem, (5, 5), 0.0, 0.0, 10.0).collect()}
    assert out[0].surface_z == 13.0 and out[0].slope == pytest.approx(math.degrees(math.atan(0.2))) and not out[0].dem_missing
    assert out[1].surface_z == 10.0 and out[1].dem_missing and out[2].surface_z is None and out[2].dem_missing


def test_grid_checks(spark):
    points = spark.createDataFrame([(0.0, 0.0), (4.0, 0.0), (500.0, 0.0)], "x double, y double")
    cells = grid.grid_cells(points, (3, 3), 0.0, 0.0, 10.0)
    assert [(r.col, r.inside, r.aligned) for r in cells.orderBy("x").collect()] == [(0, True, True), (0, True, False), (50, False, True)]
    with pytest.raises(ValueError, match="not on the grid"):
        grid.require_placed(cells)
    with pytest.raises(ValueError, match="two points"):
        grid.require_placed(grid.grid_cells(spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "x double, y double"), (3, 3), 0.0, 0.0, 10.0))


def test_text_matrix_and_coverage(spark):
    mask = spark.createDataFrame([(0, 0, 0), (0, 1, -2), (1, 0, 10), (1, 1, 0)], "row long, col long, value int")
    predictions = spark.createDataFrame([(0, 1, 1.5), (1, 0, 2.0)], "row long, col long, prediction double")
    assert [r.line for r in grid.text_matrix(mask, predictions, (2, 2)).orderBy("row").collect()] == ["0.000000 1.500000", "2.000000 0.000000"]
    assert grid.coverage(mask, predictions).first().status == "complete"
    partial = grid.coverage(mask, predictions.limit(1)).first()
    assert (partial.status, partial.missing_cells) == ("partial", 1)
    with pytest.raises(Exception, match="no finite value"):
        grid.text_matrix(mask, predictions.limit(1), (2, 2)).collect()
    assert {(r.row, r.col, r.side) for r in grid.mask_edges(mask).collect()} == {(0, 0, "right"), (1, 0, "right"), (0, 0, "up"), (0, 1, "up")}


def test_upsert_and_crosstab(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k int, s string, n int")
    assert sorted(map(tuple, joins.upsert(old, new, "k").collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    out = summaries.crosstab(old.withColumnRenamed("s", "r"), "r", "n", ["a", "z"], ["1", "2"]).orderBy("r").collect()
    assert [tuple(r) for r in out] == [("a", 1, 0, 1), ("z", 0, 0, 0)]


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([(1.0, "A", 1.0), (2.0, "B", 2.0), (None, "A", 3.0)], "x double, geology string, y double")
    fitted = ml.preprocessor(["x"], ["geology"]).fit(ml.feature_frame(train, ["x"], ["geology"]))
    test = ml.feature_frame(spark.createDataFrame([(None, "C", 0.0)], "x double, geology string, y double"), ["x"], ["geology"])
    assert list(fitted.transform(test).first().features.toArray()) == [1.0, 0.0, 0.0]


def test_models(spark):
    rows = spark.range(200).select((F.col("id") % 40).alias("hole"), (F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("g"), ((F.col("id") % 17) * 2 + 1).cast("double").alias("y"))
    out = ml.out_of_fold(rows, "y", ["x"], ["g"], "hole", 2, "s", ml.linear("y"))
    assert out.count() == 200 and summaries.regression_metrics(out, "y", "prediction").first().r2 > 0.999
    told = ml.pseudo_labelled(rows.limit(100), rows.limit(20).drop("y").withColumn("route", F.lit("B")), "y", {"B": (["x"], [])}, "route")
    assert {r.label_source: r["count"] for r in told.groupBy("label_source").count().collect()} == {"measured": 100, "predicted": 20}
    e = ml.seed_ensemble(rows, rows.limit(5), "y", ["x"], [], [1, 2], 4.0)
    assert all(r.lower <= r.prediction <= r.upper for r in e.collect())
