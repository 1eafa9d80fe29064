"""Tiles, outlines, overlays and cell pyramids against plain rules."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.operators import grid, joins, overlay, pyramid, raster, spatial

RINGS = "poly_id long, code string, rings array<array<struct<x:double,y:double>>>"


def plain_terrain(dem, x, y, x0, y0, step):
    """(surface_z, slope, curvature, missing) of one place, from an array with nan for absent cells."""
    rows, cols = dem.shape

    def at(x, y):
        c, r = (x - x0) / step, (y - y0) / step
        if not (0 <= c <= cols - 1 and 0 <= r <= rows - 1):
            return 0.0, True, False
        c0, r0 = min(int(c), cols - 2), min(int(r), rows - 2)
        z, bad = 0.0, False
        for i in (0, 1):
            for j in (0, 1):
                v = dem[r0 + i, c0 + j]
                wrong = not np.isfinite(v) or v < 0
                bad |= wrong
                z += (0.0 if wrong else v) * ((r - r0) if i else 1 - (r - r0)) * ((c - c0) if j else 1 - (c - c0))
        return z, bad, True

    (c, b, inside), (w, b1, _), (e, b2, _), (s, b3, _), (n, b4, _) = at(x, y), at(x - step, y), at(x + step, y), at(x, y - step), at(x, y + step)
    if not inside:
        return None, None, None, True
    return c, math.degrees(math.atan(math.hypot((e - w) / (2 * step), (n - s) / (2 * step)))), (e - 2 * c + w) / step**2 + (n - 2 * c + s) / step**2, b or b1 or b2 or b3 or b4


def dem_of(seed=1, shape=(23, 17)):
    rng = np.random.default_rng(seed)
    dem = rng.normal(30, 20, shape)
    dem[rng.random(shape) < 0.05] = np.nan
    return dem


@pytest.mark.parametrize("size", [4, 7, 128])
def test_samples_of_tiles_against_single_cells(spark, size):
    dem, step = dem_of(), 10.0
    cells = [(r, c, float(v)) for (r, c), v in np.ndenumerate(dem) if np.isfinite(v)]
    df = spark.createDataFrame([*cells, (99, 0, 1.0), (-1, 2, 1.0), cells[0][:2] + (-5.0,), (3, 3, float("inf"))], "row long, col long, value double")
    dem[3, 3] = np.inf
    rng = np.random.default_rng(2)
    places = [(float(x), float(y)) for x, y in rng.uniform(-15, 245, (150, 2))] + [(100.0 + 10 * i, 200.0 + 10 * j) for i in range(17) for j in range(23)] + [(260.0, 420.0), (100.0, 200.0), (None, 3.0), (float("nan"), 210.0), (float("inf"), 210.0)]
    points = spark.createDataFrame([(i, x, y, "k", 1) for i, (x, y) in enumerate(places)] + [(0, *places[0], "k", 1)], "point_id long, x double, y double, values string, tile_row int")
    tiles = raster.tiles_of_cells(df, dem.shape, size)
    got = raster.sample(points.drop("values", "tile_row"), tiles, dem.shape, 100.0, 200.0, step, size).collect()
    assert len(got) == len(places) + 1
    for r in got:
        x, y = places[r.point_id]
        want = (None, None, None, True) if x is None or not math.isfinite(x) else plain_terrain(dem, x, y, 100.0, 200.0, step)
        assert r.dem_missing == want[3]
        for a, b in zip((r.surface_z, r.slope, r.curvature), want, strict=False):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))
    assert grid.terrain_at(points.limit(0), df, dem.shape, 100.0, 200.0, step).count() == 0
    assert all(r.dem_missing for r in grid.terrain_at(points, df.limit(0), dem.shape, 100.0, 200.0, step).collect())


@pytest.mark.parametrize("size", [5, 64])
def test_terrain_of_whole_tiles_has_the_values_of_points_on_cells(spark, size):
    dem = dem_of(4)
    df = spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(dem) if np.isfinite(v)], "row long, col long, value double")
    got = {(r.row, r.col): r for r in raster.terrain(raster.tiles_of_cells(df, dem.shape, size), dem.shape, 10.0, size).collect()}
    assert len(got) == dem.size
    for (r, c), row in got.items():
        want = plain_terrain(dem, 10.0 * c, 10.0 * r, 0.0, 0.0, 10.0)
        missing = any(not (0 <= r + i < dem.shape[0] and 0 <= c + j < dem.shape[1] and dem[r + i, c + j] >= 0) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))
        assert (row.surface_z, row.slope, row.curvature, row.dem_missing) == (pytest.approx(want[0]), pytest.approx(want[1]), pytest.approx(want[2], abs=1e-12), missing)


def test_tiles_of_lines_are_tiles_of_cells(spark):
    dem = np.nan_to_num(dem_of(5, (11, 13)), nan=-1.0)
    lines = spark.createDataFrame([(r, dem[r].tolist()) for r in range(11)], "row long, values array<double>")
    cells = spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(dem)], "row long, col long, value double")
    rows = lambda t: sorted((r.tile_row, r.tile_col, r["values"]) for r in t.collect())
    assert rows(raster.tiles_of_lines(lines, (11, 13), 4)) == rows(raster.tiles_of_cells(cells, (11, 13), 4))
    back = raster.cells_of_tiles(raster.tiles_of_lines(lines, (11, 13), 4), (11, 13), 4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    with pytest.raises(Exception, match="doesn't fit the shape"):
        raster.tiles_of_lines(lines, (11, 12), 4).collect()


def test_cached_tiles_follow_their_file(spark, tmp_path):
    file, cache = tmp_path / "dem.txt", str(tmp_path / "cache")
    file.write_text("1 2 3\n4 5 6\n")
    first = sorted(map(tuple, raster.cells_of_tiles(raster.cached_tiles(spark, str(file), cache, (2, 3)), (2, 3)).collect()))
    assert first == [(r, c, 1.0 + 3 * r + c) for r in range(2) for c in range(3)]
    raster.cached_tiles(spark, str(file), cache, (2, 3))
    assert len(list((tmp_path / "cache").iterdir())) == 1
    next((tmp_path / "cache").iterdir()).joinpath("_SUCCESS").unlink()  # as after a crash: made anew
    assert raster.cached_tiles(spark, str(file), cache, (2, 3)).count() == 1
    file.write_text("1 2 3\n4 5 60\n")
    assert max(r.value for r in raster.cells_of_tiles(raster.cached_tiles(spark, str(file), cache, (2, 3)), (2, 3)).collect()) == 60.0
    file.write_text("1 2\n4 5 60\n")
    with pytest.raises(ValueError, match="another shape"):
        raster.cached_tiles(spark, str(file), cache, (2, 3))


@pytest.mark.parametrize("size", [3, 64])
def test_boundary_lines_are_whole_and_in_order(spark, size):
    mask = np.zeros((14, 12), int)
    mask[2:9, 3:9], mask[4:6, 5:7], mask[11, 4], mask[0:2, 0:2], mask[12, 5] = 1, 0, -3, 1, 1
    df = spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(mask)], "row long, col long, value double")
    segments = raster.boundary_segments(raster.tiles_of_cells(df, mask.shape, size), mask.shape, size)
    pieces = {(r.start_row, r.start_col): (r.end_row, r.end_col) for r in segments.collect()}
    assert len(pieces) == segments.count()
    lines = {}
    for r in raster.boundary_lines(segments).collect():
        lines.setdefault((r.line, r.closed), []).append((r.position, (r.row, r.col)))
    used = 0
    for (name, closed), points in lines.items():
        points.sort()
        assert [p for p, _ in points] == list(range(len(points)))
        path = [q for _, q in points]
        assert name == f"{path[0][0]},{path[0][1]}" and all(pieces[a] == b for a, b in zip(path, path[1:], strict=False))
        assert not closed or (pieces[path[-1]] == path[0] and path[0] == min(path))
        assert closed or path[-1] not in pieces
        used += len(path) - (not closed)
    assert used == len(pieces) and sorted(c for _, c in lines) == [False, True, True, True, True]
    assert raster.boundary_lines(segments.limit(0)).count() == 0


def edges_of(rings):
    return [(*r[i], *r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]


def plain_place(rings, x, y):
    """i inside, b on the boundary, None outside."""
    edges = edges_of(rings)
    if any((c - a) * (y - b) - (d - b) * (x - a) == 0 and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d) for a, b, c, d in edges):
        return "b"
    return "i" if sum((b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b) for a, b, c, d in edges) % 2 else None


def stars(seed=3, n=16):
    rnd = random.Random(seed)

    def star(whole):
        cx, cy, k = rnd.uniform(-5, 5), rnd.uniform(-5, 5), rnd.randint(3, 14)
        place = lambda v: float(round(v)) if whole else v
        return [(place(cx + rnd.uniform(2, 9) * math.cos(2 * math.pi * i / k)), place(cy + rnd.uniform(2, 9) * math.sin(2 * math.pi * i / k))) for i in range(k)]

    return [(i, f"c{i % 3}", [star(i % 2 == 1), *([star(True)] if i % 4 == 0 else [])]) for i in range(n)]


@pytest.mark.parametrize("cell", [0.7, 1.0, 5.0, 60.0])
def test_points_in_outlines_cut_by_cells(spark, cell):
    """Corners and edges on cell sides, holes, self-crossing outlines, repeated corners; points on all of them."""
    shapes = stars() + [(50, "s", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]), (51, "none", []), (52, "point", [[(1.0, 1.0)]])]
    rnd = random.Random(1)
    places = [(rnd.uniform(-14, 14), rnd.uniform(-14, 14)) for _ in range(150)] + [(float(x), float(y)) for x in range(-14, 15, 2) for y in range(-14, 15)] + [(x + 0.5, y + 0.25) for x in range(-9, 9) for y in range(-9, 9)]
    points = spark.createDataFrame([(i, x, y, "z", "z") for i, (x, y) in enumerate(places)] + [(-1, None, 0.0, "z", "z")], "point_id long, x double, y double, code string, cx string")
    want = {(i, k, kind) for i, (x, y) in enumerate(places) for k, _, rings in shapes if (kind := plain_place(rings, x, y))}
    got = [(r.point_id, r.poly_id, "b" if r.on_boundary else "i") for r in spatial.candidates(points, spark.createDataFrame(shapes, RINGS), cell).collect()]
    assert set(got) == want and len(got) == len(want)


def test_no_cell_holds_a_whole_outline(spark):
    n = 2000
    ring = [(50 + 40 * math.cos(2 * math.pi * i / n), 50 + 40 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    index = spatial.cell_index(spark.createDataFrame([(1, "a", [ring])], RINGS), 2.0)
    most, inside = index.agg(F.max(F.size("edges")), F.count_if(F.col("edges").isNull())).first()
    assert most < 40 and inside > 1000


def test_union_areas_of_rectangles(spark):
    rnd = random.Random(4)
    boxes = [(i, f"k{i % 2}", rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(1, 9), rnd.randint(1, 9)) for i in range(25)]
    shapes = spark.createDataFrame([(i, k, [[(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]]) for i, k, x, y, w, h in boxes], RINGS)
    filled = {}
    for _, k, x, y, w, h in boxes:
        filled.setdefault(k, np.zeros((40, 40), bool))[y : y + h, x : x + w] = True
    for cell, most in ((4.0, 128), (50.0, 8)):
        assert {r.code: r.area for r in overlay.union_areas(shapes, cell, most=most).collect()} == {k: pytest.approx(v.sum()) for k, v in filled.items()}
    window = (3.0, 5.0, 21.0, 17.0)
    inside = {k: v[5:17, 3:21].sum() for k, v in filled.items()}
    both = sum(filled.values()).astype(bool)[5:17, 3:21].sum()
    got = {r.code: r for r in overlay.area_fractions(shapes, 4.0, window).collect()}
    assert {k: r.area for k, r in got.items()} == {k: pytest.approx(v) for k, v in inside.items()}
    assert all(r.fraction_of_bounds == pytest.approx(inside[k] / 216) and r.fraction_of_covered == pytest.approx(inside[k] / both) for k, r in got.items())
    a, b = shapes.filter("code = 'k0'"), shapes.filter("code = 'k1'")
    assert [(r.code_a, r.code_b, r.area) for r in overlay.overlay_areas(a, b, 4.0, most=10).collect()] == [("k0", "k1", pytest.approx((filled["k0"] & filled["k1"]).sum()))]
    assert overlay.union_areas(shapes.limit(0), 4.0).count() == 0 and overlay.union_areas(shapes.limit(0), 4.0, None).first().area is None


@pytest.mark.parametrize(("cell", "most"), [(3.0, 128), (60.0, 24)])
def test_union_areas_against_a_fine_grid(spark, cell, most):
    shapes = stars(9, 12)
    n, half = 900, 16.0
    xs = (np.arange(n) + 0.5) / n * 2 * half - half
    x, y = np.meshgrid(xs, xs)
    filled = {}
    for _, k, rings in shapes:
        inside = np.zeros_like(x, bool)
        for a, b, c, d in edges_of(rings):
            if b != d:
                inside ^= ((b > y) != (d > y)) & (x < a + (y - b) * (c - a) / (d - b))
        filled[k] = filled.get(k, np.zeros_like(x, bool)) | inside
    for r in overlay.union_areas(spark.createDataFrame(shapes, RINGS), cell, most=most).collect():
        assert r.area == pytest.approx(filled[r.code].sum() * (2 * half / n) ** 2, rel=2e-3)


def scattered(seed, n):
    """Even, crowded and equal places, with keys that repeat."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.uniform(0, 1000, (n, 2)), rng.normal(500, 3, (n, 2)), np.full((n // 2, 2), 250.0), np.full((n // 2, 2), [350.0, 250.0])])
    return [(int(k), float(a), float(b)) for k, (a, b) in zip(rng.integers(0, 2 * n, len(x)), x, strict=True)]


@pytest.mark.parametrize("itself", [True, False])
@pytest.mark.parametrize(("pairs", "single"), [(4, 0), (4, 3), (1 << 18, 64), (1 << 18, 0)])
def test_counts_and_nearest_against_all_pairs(spark, monkeypatch, itself, pairs, single):
    monkeypatch.setattr(pyramid, "SINGLE", single)
    points, refs, radius = scattered(1, 60), scattered(2, 80), 100.0
    p = spark.createDataFrame([*points, (7, None, 1.0), (8, float("nan"), 1.0)], "k long, x double, y double")
    r = spark.createDataFrame([*refs, (9, None, None), (None, 500.0, 500.0)], "ref long, x double, y double")
    d = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)
    near = lambda a, q: [b for b in q if d(a, b) <= radius and (itself or b[0] != a[0])]
    counts = sorted((a[0], len(near(a, [*refs, (None, 500.0, 500.0)]))) for a in points)
    assert sorted(map(tuple, pyramid.radius_counts(p, r, radius, "k", "ref", itself, pairs).collect())) == counts
    best = {}
    for a in points:
        for b in near(a, refs):
            best[a[0]] = min(best.get(a[0], (math.inf, 0)), (d(a, b), b[0]))
    got = {x.k: (x.nearest_distance, x.nearest_ref) for x in pyramid.nearest_within(p, r, radius, "k", "ref", itself).collect()}
    assert got == best
    assert pyramid.nearest_within(p, r.limit(0), radius, "k", "ref", itself).count() == 0
    assert {n for _, n in map(tuple, pyramid.radius_counts(p, r.limit(0), radius, "k", "ref", itself).collect())} == {0}
    assert pyramid.radius_counts(p.limit(0), r, radius, "k", "ref", itself).count() == 0


def test_a_crowded_cell_makes_no_pairs(spark):
    """100,000 points in one cell of the radius: counts and nearest references without meeting one another (they would be 10^10 pairs)."""
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("k"), (F.rand(1) * 30).alias("x"), (F.rand(2) * 30).alias("y"))
    rows = spark.createDataFrame(rows.toPandas())
    out = joins.nearest_reference(rows, rows.withColumnRenamed("k", "ref"), 100.0, "k", "ref", itself=False)
    assert out.agg(F.min("n_within"), F.max("n_within"), F.count("nearest_ref"), F.max("nearest_distance") < 3).first() == (n - 1, n - 1, n, True)
    assert joins.exclude_near(rows, rows.limit(50_000).select("x", "y"), 100.0, "k").count() == 0
