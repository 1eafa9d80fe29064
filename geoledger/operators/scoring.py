"""Scoring a grid end to end: place points on the grid, keep the mask's cells, enrich, predict, write, audit.

A job is one DataFrame: Spark splits the points, so there is no chunk loop; a stopped run goes on by the chunks that are there
(`sinks.chunks`, policy resume) or by a file stream (`streaming.scoring`)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, code_text, invalid_ground, is_finite, meshcode_250m
from ..sources import sinks
from . import grid, raster, spatial

Predictor = Callable[[DataFrame], DataFrame]


def active_points(points: DataFrame, mask: DataFrame, shape: tuple[int, int], xmin: float, ymin: float, step: float) -> DataFrame:
    """points with row and col, in active cells of the mask only. The job fails on a point between grid lines or two points in an active cell."""
    placed = grid.grid_cells(points, shape, xmin, ymin, step).filter("inside")
    kept = placed.join(mask.filter("value <> 0").select("row", "col"), ["row", "col"], "left_semi")
    alone = F.count("*").over(Window.partitionBy("row", "col")) == 1
    kept = kept.withColumns({"_alone": F.assert_true(alone, F.lit("two points in an active cell")), "_aligned": F.assert_true("aligned", F.lit("points are not on the grid"))})
    return kept.filter("_alone IS NULL AND _aligned IS NULL").drop("_alone", "_aligned", "inside", "aligned")


def enrich(points: DataFrame, dem: DataFrame, dem_shape: tuple[int, int], dem_origin: tuple[float, float], dem_spacing: float, zones: DataFrame | None = None, cell: float = 7000.0, mesh: DataFrame | None = None, where: tuple[Column, Column] | None = None) -> DataFrame:
    """points (point_id, x, y, depth) with what samples and grid cells are predicted from alike: surface_z, slope, curvature, elevation, and
    where given zone (polygons) and the mesh's attributes (mesh: CODE, JCODE, AVS; where: longitude, latitude)."""
    tiles = dem if "values" in dem.columns else raster.tiles_of_cells(dem, dem_shape)
    out = raster.sample(points, tiles, dem_shape, *dem_origin, dem_spacing).withColumn("elevation", F.col("surface_z") - F.col("depth"))
    if zones is not None:
        found = spatial.first_match(points, zones, cell).select("point_id", F.coalesce("code", F.lit("UNKNOWN")).alias("zone"))
        out = out.join(found, "point_id", "left")
    if mesh is not None and where is not None:
        bad = invalid_ground(F.col("JCODE"), F.col("AVS"))
        ground = mesh.select(F.col("CODE").alias("meshcode"), code_text(F.when(~bad, F.col("JCODE"))).alias("jcode"), F.when(~bad, F.col("AVS")).alias("avs30"))
        out = out.withColumn("meshcode", meshcode_250m(*where)).join(ground, "meshcode", "left").withColumn("jcode", F.coalesce("jcode", F.lit("UNKNOWN")))
    return out


def score(points: DataFrame, mask: DataFrame, shape: tuple[int, int], xmin: float, ymin: float, step: float, predict: Predictor, kinds: Sequence[str], least: float | None = None, most: float | None = None) -> DataFrame:
    """row, col, x, y and a value of each kind for every active cell that has a point. predict adds the kinds' columns (a fitted model's transform, a
    pandas function, an expression); a value that isn't finite fails the job. Limits are applied after prediction; clipped_<kind> tells where."""
    out = predict(active_points(points, mask, shape, xmin, ymin, step))
    for k in kinds:
        out = out.withColumn(k, F.when(F.assert_true(is_finite(F.col(k)), F.lit(f"a prediction of {k} is not finite")).isNull(), F.col(k)))
        if least is not None or most is not None:
            low, high = (float("-inf") if least is None else least), (float("inf") if most is None else most)
            out = out.withColumns({f"clipped_{k}": (F.col(k) < low) | (F.col(k) > high), k: clip(F.col(k), low, high)})
    return out.select("row", "col", "x", "y", *kinds, *(f"clipped_{k}" for k in kinds if least is not None or most is not None))


def report(points: DataFrame, mask: DataFrame, scored: DataFrame, shape: tuple[int, int], xmin: float, ymin: float, step: float, kinds: Sequence[str], partial: bool = False) -> DataFrame:
    """One row: input rows outside the grid and in masked cells, active, predicted and missing cells, extremes and clipped values of each kind, rows
    where dry exceeds wet, and the status: complete only if no active cell is missing, something was predicted and nothing was left out."""
    placed = grid.grid_cells(points, shape, xmin, ymin, step).select("row", "col", "inside")
    active = mask.filter("value <> 0").select("row", "col", F.lit(True).alias("active"))
    rows = placed.join(active, ["row", "col"], "left").agg(F.count_if(~F.col("inside")).alias("outside_rows"), F.count_if(F.col("inside") & F.col("active").isNull()).alias("masked_rows"))
    both = active.join(scored, ["row", "col"], "left")
    there = F.col(kinds[0]).isNotNull()
    counts = [F.count("*").alias("active_cells"), F.count_if(there).alias("predicted_cells"), F.count_if(~there).alias("missing_cells")]
    for k in kinds:
        counts += [F.min(k).alias(f"{k}_least"), F.max(k).alias(f"{k}_most")]
        counts += [F.count_if(f"clipped_{k}").alias(f"{k}_clipped")] if f"clipped_{k}" in scored.columns else []
    if {"dry", "wet"} <= set(kinds):
        counts.append(F.count_if(F.col("dry") > F.col("wet")).alias("dry_above_wet"))
    status = F.when((F.col("missing_cells") == 0) & (F.col("predicted_cells") > 0) & F.lit(not partial), "complete").otherwise("incomplete")
    # two rows of one row each
    return both.agg(*counts).join(F.broadcast(rows)).withColumn("status", status)


def score_chunks(points: DataFrame, chunk: str, mask: DataFrame, shape: tuple[int, int], xmin: float, ymin: float, step: float, predict: Predictor, kinds: Sequence[str], path: str, policy: str = "resume") -> None:
    """As score(), written as gzip CSV in a folder for each chunk of the input; with resume only chunks that aren't there are predicted."""
    placed = active_points(points, mask, shape, xmin, ymin, step)
    sinks.chunks(predict(placed).select("row", "col", "x", "y", *kinds, chunk), path, chunk, policy)


def difference(scored: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two models on the same cells: n, mean of each, mean, mean absolute and largest difference (b less a)."""
    d = F.col(b) - F.col(a)
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(a).alias(f"{a}_mean"), F.avg(b).alias(f"{b}_mean"), F.avg(d).alias("difference_mean"), F.avg(F.abs(d)).alias("difference_abs_mean"), F.max(F.abs(d)).alias("difference_most"))


def display_cells(scored: DataFrame, display_mask: DataFrame, stride: int) -> DataFrame:
    """Every stride-th cell in both directions that the display mask shows; cells outside the mask's matrix aren't shown."""
    shown = scored.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    return shown.join(display_mask.filter("value <> 0").select("row", "col"), ["row", "col"], "left_semi")


def overlay(observations: DataFrame, depth: float, tolerance: float) -> DataFrame:
    """x, y, value, samples, observed_depth: at each place the observations nearest to the depth within the tolerance, ties averaged. No other
    selection applies: what was measured is shown, used for training or not."""
    from .joins import select_nearest

    usable = observations.filter(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("value")))
    found = select_nearest(usable, ["x", "y"], F.col("depth"), depth, tolerance, "value")
    return found.select("x", "y", "value", "samples", F.col("position").alias("observed_depth"))
