"""Grids: terrain at points, mask boundaries, coverage of predictions, text matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import grid_index, is_finite, on_grid
from . import raster
from .ledger import assert_none


def terrain_at(points: DataFrame, dem: DataFrame, shape: tuple[int, int], xmin: float, ymin: float, spacing: float) -> DataFrame:
    """point_id with surface_z, slope (degrees), curvature, dem_missing, a row for each point.

    points: point_id, x, y; dem: cells (row, col, value) or tiles of them. See `raster.sample` for what is missing or outside."""
    tiles = dem if "values" in dem.columns else raster.tiles_of_cells(dem, shape)
    return raster.sample(points.select("point_id", "x", "y"), tiles, shape, xmin, ymin, spacing).drop("x", "y")


def mask_edges(cells: DataFrame) -> DataFrame:
    """row, col, side (right or up) of neighbouring cells (row, col, value) of which just one is active (non-zero)."""
    active = cells.select("row", "col", (F.col("value") != 0).alias("active"))
    right = active.select("row", (F.col("col") - 1).alias("col"), F.col("active").alias("other"), F.lit("right").alias("side"))
    up = active.select((F.col("row") - 1).alias("row"), "col", F.col("active").alias("other"), F.lit("up").alias("side"))
    return active.join(right.union(up), ["row", "col"]).filter("active <> other").select("row", "col", "side", "active")


def grid_cells(points: DataFrame, shape: tuple[int, int], xmin: float, ymin: float, step: float) -> DataFrame:
    """points with row, col, inside, aligned."""
    rows, cols = shape
    out = points.withColumns({"col": grid_index(F.col("x"), xmin, step), "row": grid_index(F.col("y"), ymin, step)})
    out = out.withColumn("inside", F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    return out.withColumn("aligned", on_grid(F.col("x"), F.col("col"), xmin, step) & on_grid(F.col("y"), F.col("row"), ymin, step))


def require_placed(cells: DataFrame) -> DataFrame:
    """Raises for points inside but between grid lines, and for two points in a cell."""
    assert_none(cells, F.col("inside") & ~F.col("aligned"), "points are not on the grid")
    return assert_none(cells.filter("inside").groupBy("row", "col").count(), F.col("count") > 1, "two points in a cell")


def coverage(mask: DataFrame, predictions: DataFrame, least: float = 0.0, most: float = 50.0) -> DataFrame:
    """One row: active, predicted, missing and outside cells, extremes, values under and over limits, status."""
    m = mask.filter("value <> 0").select("row", "col", F.lit(True).alias("active"))
    p = predictions.select("row", "col", "prediction")
    both = m.join(p, ["row", "col"], "full").withColumn("active", F.coalesce("active", F.lit(False)))
    fine = is_finite(F.col("prediction"))
    counts = both.agg(
        F.count_if("active").alias("active_cells"), F.count_if(F.col("active") & fine).alias("predicted_cells"), F.count_if(F.col("active") & ~fine).alias("missing_cells"), F.count_if(~F.col("active") & fine).alias("outside_cells"),
        F.min(F.when(F.col("active"), F.col("prediction"))).alias("least"), F.max(F.when(F.col("active"), F.col("prediction"))).alias("most"), F.count_if(F.col("active") & (F.col("prediction") < least)).alias("under"), F.count_if(F.col("active") & (F.col("prediction") > most)).alias("over"),
    )
    return counts.withColumn("status", F.when((F.col("active_cells") > 0) & (F.col("missing_cells") == 0), "complete").otherwise("partial"))


def text_matrix(mask: DataFrame, predictions: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """row, line: the matrix as text, six decimals, zero outside the mask; a row is one group of `shape[1]` cells at most."""
    spine = mask.sparkSession.range(shape[0]).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shape[1] - 1).cast("long"))).alias("col"))
    active = mask.filter("value <> 0").select("row", "col", F.lit(True).alias("active"))
    cells = spine.join(active, ["row", "col"], "left").join(predictions.select("row", "col", "prediction"), ["row", "col"], "left")
    cells = cells.withColumn("v", F.when(F.col("active"), F.col("prediction")).otherwise(0.0))
    wrong = F.assert_true(is_finite(F.col("v")), F.lit("a cell inside the mask has no finite value"))
    cells = cells.withColumn("t", F.coalesce(wrong.cast("string"), F.format_string("%.6f", "v")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "t"))), lambda s: s["t"]), " ")
    return cells.groupBy("row").agg(line.alias("line"))


def shallowest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The measurement of least depth, then largest value, of each key: one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("depth", F.col("n_value").isNull().alias("_u"), (-F.col("n_value")).alias("_n"), *(c for c in rest if c not in ("depth", "n_value")))).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(df.columns)


def grid_shape(xmin: float, xmax: float, ymin: float, ymax: float, step: float) -> tuple[int, int]:
    """Rows and columns of a grid whose bounds are both on grid lines; raises otherwise."""
    shape = []
    for low, high in ((ymin, ymax), (xmin, xmax)):
        n = round((high - low) / step)
        if n < 1 or step <= 0 or abs(low + n * step - high) > 1e-6 * step:
            raise ValueError("bounds and spacing don't make whole cells")
        shape.append(n + 1)
    return shape[0], shape[1]


def display_raster(points: DataFrame, spacing: float, value: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """(row, col, value of regularly spaced points; one row with rows, cols and the picture's edges, half a cell outside the outer points). Cells without
    a point have no row. Of points in one cell the one farthest right, then highest, then of largest value counts. No points: nulls."""
    edge = points.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))  # one row
    at = lambda v, low: F.rint((F.col(v) - F.col(low)) / spacing).cast("long")
    placed = points.join(F.broadcast(edge)).select(at("y", "_y0").alias("row"), at("x", "_x0").alias("col"), "x", "y", F.col(value).alias("value"))
    cells = placed.groupBy("row", "col").agg(F.max_by("value", F.struct("x", "y", "value")).alias("value"))
    count = lambda low, high: (F.rint((F.col(high) - F.col(low)) / spacing) + 1).cast("long")
    half = spacing / 2
    return cells, edge.select(count("_y0", "_y1").alias("rows"), count("_x0", "_x1").alias("cols"), (F.col("_x0") - half).alias("left"), (F.col("_x1") + half).alias("right"), (F.col("_y0") - half).alias("bottom"), (F.col("_y1") + half).alias("top"))
