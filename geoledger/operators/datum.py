"""Datum shift by a correction table: seconds of latitude and longitude at the corners of a mesh, between them in proportion.

Corrections lie in tiles with a border (see `raster`), so a point meets one row by equal keys. Forwards a point gets its own place's correction. Backwards the
place is sought whose corrected place is the point, by iteration inside the tile: as corrections change slowly, each round gains several digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from . import raster

#: Rounds of the inverse. A correction that differs by 1/1000 of its distance leaves 10^-18 of itself after six.
ROUNDS = 6


def correction_tiles(table: DataFrame, shape: tuple[int, int], size: int = raster.SIZE) -> DataFrame:
    """Tiles of a table (row, col, dlat, dlon; seconds): tile_row, tile_col, dlat, dlon. Corners that the table lacks, or of which one correction is null or not finite, are null."""
    good = table.filter(is_finite(F.col("dlat")) & is_finite(F.col("dlon")))
    parts = [raster.tiles_of_cells(good.select("row", "col", F.col(c).alias("value")), shape, size).withColumnRenamed("values", c) for c in ("dlat", "dlon")]
    return parts[0].join(parts[1], raster.TILE)


def shifted(points: DataFrame, tiles: DataFrame, shape: tuple[int, int], south: float, west: float, step_lat: float, step_lon: float, inverse: bool = False, size: int = raster.SIZE) -> DataFrame:
    """points (lon, lat and more) with shifted_lon, shifted_lat (degrees) and shift_missing: a point outside the mesh, without a place, or at a corner that has no
    correction keeps null. south and west: the place of row 0, column 0; steps in degrees."""
    rows, cols = shape
    side = size + 2 * raster.HALO
    tile = lambda f, n: F.floor(F.least(F.floor(f), F.lit(n - 2)) / size)
    r0, c0 = (F.col("lat") - south) / step_lat, (F.col("lon") - west) / step_lon
    within = F.coalesce(is_finite(r0) & is_finite(c0) & r0.between(0, rows - 1) & c0.between(0, cols - 1), F.lit(False))
    placed = points.withColumns({"_tile_row": F.when(within, tile(r0, rows)), "_tile_col": F.when(within, tile(c0, cols))})
    met = placed.join(tiles.select(*(F.col(t).alias(f"_{t}") for t in raster.TILE), F.col("dlat").alias("_dlat"), F.col("dlon").alias("_dlon")), ["_tile_row", "_tile_col"], "left")

    def corrections(lat: Column, lon: Column) -> tuple[Column, Column]:
        """Degrees at a place in the point's tile or its border."""
        r, c = (lat - south) / step_lat, (lon - west) / step_lon
        low_r, low_c = (F.greatest(F.least(F.floor(f), F.lit(n - 2)), F.lit(0)) for f, n in ((r, rows), (c, cols)))
        at = lambda v, i, j: F.get(v, ((low_r + i - F.col("_tile_row") * size + raster.HALO) * side + low_c + j - F.col("_tile_col") * size + raster.HALO).cast("int"))
        weight = lambda i, j: ((r - low_r) if i else (1 - r + low_r)) * ((c - low_c) if j else (1 - c + low_c))
        return tuple(sum((at(v, i, j) * weight(i, j) for i in (0, 1) for j in (0, 1)), F.lit(0.0)) / 3600 for v in ("_dlat", "_dlon"))

    if not inverse:
        dlat, dlon = corrections(F.col("lat"), F.col("lon"))
        out = met.withColumns({"shifted_lat": F.col("lat") + dlat, "shifted_lon": F.col("lon") + dlon})
    else:
        out = met.withColumns({"shifted_lat": F.when(F.col("_tile_row").isNotNull(), F.col("lat")), "shifted_lon": F.when(F.col("_tile_row").isNotNull(), F.col("lon"))})
        for _ in range(ROUNDS):
            dlat, dlon = corrections(F.col("shifted_lat"), F.col("shifted_lon"))
            out = out.withColumns({"shifted_lat": F.col("lat") - dlat, "shifted_lon": F.col("lon") - dlon})
    missing = F.col("shifted_lat").isNull() | F.col("shifted_lon").isNull()
    keep = lambda c: F.when(~missing, F.col(c)).alias(c)
    return out.select(*points.columns, keep("shifted_lon"), keep("shifted_lat"), missing.alias("shift_missing"))
