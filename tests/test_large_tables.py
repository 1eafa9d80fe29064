"""What only shows on larger tables, told by plans and counts on small ones."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from geoledger.operators import graph, joins, ml, overlay, spatial, summaries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_places_is_broadcast(spark):
    holes = spark.range(300).select(F.col("id").alias("hole_id"), (F.col("id") * 37 % 1000).cast("double").alias("x"), (F.col("id") * 91 % 1000).cast("double").alias("y"))
    refs = holes.withColumnRenamed("hole_id", "ref_id")
    for itself in (True, False):
        assert "BroadcastHashJoin" not in _plan(joins.pyramid.nearest_within(holes, refs, 150.0, "hole_id", "ref_id", itself))
        assert "BroadcastHashJoin" not in _plan(joins.pyramid.radius_counts(holes, refs, 150.0, "hole_id", "ref_id", itself))
        assert "BroadcastHashJoin" not in _plan(joins.nearest_reference(holes, refs, 150.0, "hole_id", "ref_id", itself))


def test_shapes_that_a_cell_cannot_tell_apart_are_one(spark, monkeypatch):
    """Rectangles with a common corner lie on one another there at any depth."""
    monkeypatch.setattr(overlay, "DEEPEST", 2)
    rings = [(i, "A", [[(0.0, 0.0), (100.0 + i, 0.0), (100.0 + i, 100.0 + i), (0.0, 100.0 + i)]]) for i in range(40)]
    shapes = spark.createDataFrame(rings, "poly_id long, code string, rings array<array<struct<x:double,y:double>>>")
    cells = overlay.refined(spatial.cell_index(shapes, 50.0), 50.0, 16)
    assert [(r.level, r.corner, len(r.edges)) for r in cells.filter("cx = 0 AND cy = 0").collect()] == [(0, True, 2)]
    assert overlay.union_areas(shapes, 50.0, most=16).first().area == 139.0**2


def test_a_baseline_is_never_better_than_itself(spark):
    drawn = F.udf(lambda _: random.random(), "double").asNondeterministic()
    df = spark.range(40).select((F.col("id") % 20).alias("seed"), F.when(F.col("id") < 20, "N").otherwise("A").alias("condition"), drawn("id").alias("v"))
    rows = summaries.baseline_deltas(df, ["seed"], "condition", "N", "v").filter("condition = 'N'").collect()
    assert len(rows) == 20 and all(r.delta == 0.0 and not r.improved for r in rows)


def test_models_are_compared_on_folds_computed_once(spark):
    passed = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(i):
        passed.add(1)
        return float(i % 7)

    dealt = spark.range(60).select(F.col("id").alias("record_id"), (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 5).cast("double").alias("depth"), counted("id").alias("n_value"))
    assert ml.compare_models(dealt, "n_value", ["depth"], [], {"linear": ml.fitted_with(ml.linear("n_value"))}, "record_id", 2)[1].count() == 3
    assert passed.value == 60


def test_location_groups_against_all_pairs(spark):
    """Crowded cells whose picked places link nothing, single places, and a gap a little over the tolerance."""
    random.seed(5)
    at = [(random.uniform(0, 150), random.uniform(0, 150)) for _ in range(250)] + [(300 + random.uniform(0, 1), random.uniform(0, 6)) for _ in range(60)] + [(310.5 + random.uniform(0, 1), random.uniform(0, 6)) for _ in range(60)]
    part = list(range(len(at)))
    for i, (x, y) in enumerate(at):
        for j in range(i):
            if ((x - at[j][0]) ** 2 + (y - at[j][1]) ** 2) ** 0.5 <= 10.0 and part[i] != part[j]:
                lo, hi = sorted((part[i], part[j]))
                part = [lo if p == hi else p for p in part]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "boring_id long, x double, y double")
    assert {r.boring_id: r.location for r in graph.location_groups(points, 10.0).collect()} == dict(enumerate(part))


def test_nearest_deals_a_point_to_few_tiles(spark, monkeypatch):
    """Crowds, sparse places and an edge between them; in sum each point meets hardly more than its own tile."""
    pyramid = joins.pyramid
    random.seed(8)
    at = [(random.uniform(0, 2000), random.uniform(0, 2000)) for _ in range(1500)] + [(5000 + random.uniform(0, 3), random.uniform(0, 3)) for _ in range(500)] + [(5000 + random.uniform(-90, 90), random.uniform(-90, 90)) for _ in range(30)]
    refs = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "h long, x double, y double")
    points = [(i, x + random.uniform(-0.1, 0.1), y + random.uniform(-9, 9) / (1 if i < 1500 else 90)) for i, (x, y) in enumerate(at)]
    monkeypatch.setattr(pyramid, "TILE", 64)
    searched, dealt = pyramid._nearest_in_tiles, []

    def counted(rows, *more):
        dealt.append(rows.count())
        return searched(rows, *more)

    monkeypatch.setattr(pyramid, "_nearest_in_tiles", counted)
    found = {r.q: (r.nearest_distance, r.nearest_h) for r in pyramid.nearest_within(spark.createDataFrame(points, "q long, x double, y double"), refs, 100.0, "q", "h").collect()}
    least = {i: min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), h) for h, (a, b) in enumerate(at)) for i, x, y in points}
    assert found == {i: v for i, v in least.items() if v[0] <= 100.0}
    assert dealt[0] == len(at) and dealt[1] < len(at)
    monkeypatch.setattr(pyramid, "CROWD", 20)  # a tile's points in several tasks
    assert found == {r.q: (r.nearest_distance, r.nearest_h) for r in pyramid.nearest_within(spark.createDataFrame(points, "q long, x double, y double"), refs, 100.0, "q", "h").collect()}


def test_a_model_reads_its_rows_in_bounded_parts(spark, monkeypatch):
    parts = []

    class Counted(ml.LinearRegression):
        def _fit(self, dataset):
            parts.extend(dataset.rdd.glom().map(len).collect())
            return super()._fit(dataset)

    monkeypatch.setattr(ml, "ROWS", 20, raising=False)
    df = spark.range(0, 600, 1, 2).select((F.col("id") % 7).cast("double").alias("depth"), (F.col("id") % 5).cast("double").alias("n_value"))
    ml.fit(df, ["depth"], [], Counted(labelCol="n_value", featuresCol="features", solver="normal"))
    assert sum(parts) == 600 and max(parts) <= 25


def test_even_places_are_written_and_dealt_few_times(spark, monkeypatch):
    """A dense grid: the nearest is found without writing the rows anew for each level, and the references of a count go to few tiles."""
    pyramid = joins.pyramid
    n = 80
    h = spark.range(n * n).select(F.col("id").alias("k"), (F.col("id") % n * 10).cast("double").alias("x"), (F.floor(F.col("id") / n) * 10).cast("double").alias("y"))
    refs = h.select(F.col("k").alias("ref"), "x", "y").localCheckpoint()
    monkeypatch.setattr(pyramid, "TILE", 64)
    wrote, write, dealt = [], pyramid.written, []

    def counted(df, name):
        out = write(df, name)
        wrote.append(name)
        return out

    monkeypatch.setattr(pyramid, "written", counted)
    found = pyramid.nearest_within(h, refs, 400.0, "k", "ref", itself=False)
    assert found.filter("nearest_distance = 10").count() == n * n
    assert "nearest-told" not in wrote
    told = pyramid._counted
    monkeypatch.setattr(pyramid, "_counted", lambda df, radius: dealt.append(df.count()) or told(df, radius))
    monkeypatch.setattr(pyramid, "CROWD", 1 << 11)
    places = [(i * 10.0, j * 10.0) for i in range(n) for j in range(n)]
    some = {(x, y): sum(math.sqrt((x - a) * (x - a) + (y - b) * (y - b)) <= 400.0 for a, b in places) for x, y in places[:: 97]}
    got = {(r.x, r.y): r.n_within for r in pyramid.place_counts(h, refs, 400.0).collect()}
    assert len(got) == n * n and {p: got[p] for p in some} == some
    assert sum(dealt) < 8 * n * n


def test_places_far_apart_are_not_dealt_to_the_cells_around(spark, monkeypatch):
    """Of 300 lonely cells and two pairs, one two steps apart over a corner of blocks, only the pairs meet; measurements are made once for an estimate."""
    at = [(i * 100, i * 37) for i in range(1, 301)] + [(-3, -1), (-1, -3), (2, 900), (3, 900)]
    cells = spark.createDataFrame(at, "cx long, cy long")
    assert sorted(map(tuple, graph.neighboured(cells).collect())) == [(-3, -1), (-1, -3), (2, 900), (3, 900)]
    lonely = spark.range(200).select(F.col("id").alias("boring_id"), (F.col("id") * 10).cast("double").alias("x"), F.lit(0.0).alias("y"))
    rows, write = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rows.setdefault(name, []).append(df.count()) or write(df, name))
    assert graph.location_groups(lonely, 0.01).filter("location = boring_id").count() == 200
    assert rows["cells"] == [0] and rows["places"] == [200, 200, 0, 0]
