"""Rasters as tiles: square arrays with a border of their neighbours' cells, so that a stencil needs no other tile.

A tile is a row: tile_row, tile_col, values (array<double>, row by row, of size + 2 * HALO cells a side; null where there is no cell). Tile (i, j) holds
rows i * size - HALO to (i + 1) * size + HALO - 1, columns alike. A point meets the one tile of its cell by equal keys; a whole raster's
stencil runs inside each tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..storage import written

#: Cells of a tile's side, without the border, and the border's width: a stencil of one cell at a point between cells reads two beyond its own.
SIZE, HALO = 128, 2
TILE = ["tile_row", "tile_col"]


def _homes(index: Column, size: int, name: str) -> Column:
    """The tiles along an axis that hold a row or column: its own, and those in whose border it lies."""
    return F.explode(F.sequence(F.greatest(F.floor((index - HALO) / size), F.lit(0)), F.floor((index + HALO) / size))).alias(name)


def tiles_of_cells(cells: DataFrame, shape: tuple[int, int], size: int = SIZE) -> DataFrame:
    """Tiles of cells (row, col, value). Cells outside the shape are left out; of two values of one cell the greater counts; cells without a row are null."""
    side, (rows, cols) = size + 2 * HALO, shape
    inside = cells.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).groupBy("row", "col").agg(F.max("value").cast("double").alias("value"))
    dealt = inside.select("*", _homes(F.col("row"), size, "tile_row")).select("*", _homes(F.col("col"), size, "tile_col"))
    dealt = dealt.filter((F.col("tile_row") * size < rows) & (F.col("tile_col") * size < cols))
    place = ((F.col("row") - F.col("tile_row") * size + HALO) * side + F.col("col") - F.col("tile_col") * size + HALO).cast("int")
    packed = dealt.groupBy(*TILE).agg(F.collect_list(F.struct(place.alias("place"), "value")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in enumerate(batch.column("c")):
                place, value = (c.values.field(i) for i in (0, 1))
                given, flat = np.zeros(side * side, bool), np.zeros(side * side)
                at, here = place.to_numpy(), np.array(value.is_valid())
                flat[at[here]], given[at[here]] = value.drop_null().to_numpy(), True
                yield pa.RecordBatch.from_arrays([*(batch.column(t).slice(k, 1) for t in TILE), _lists(flat, given, side * side)], [*TILE, "values"])

    return packed.select(*(F.col(t).cast("long").alias(t) for t in TILE), "c").mapInArrow(run, "tile_row long, tile_col long, values array<double>")


def _lists(flat: np.ndarray, given: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat, mask=~given))


def tiles_of_lines(lines: DataFrame, shape: tuple[int, int], size: int = SIZE) -> DataFrame:
    """Tiles of whole lines (row, values: array of numbers): lines are cut into the tiles' stretches, so no cell is ever a row. A line of another
    length, and a row outside the shape, is refused when the tiles are read."""
    rows, cols = shape
    fits = (F.size("values") == cols) & F.col("row").between(0, rows - 1)
    checked = lines.withColumn("values", F.when(fits, F.col("values").cast("array<double>")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("row"), F.lit(" doesn't fit the shape")))))
    across = F.explode(F.sequence(F.lit(0), F.lit((cols - 1) // size))).alias("tile_col")
    start = F.col("tile_col") * size - HALO
    stretch = F.concat(F.array_repeat(F.lit(None).cast("double"), HALO), F.col("values"), F.array_repeat(F.lit(None).cast("double"), HALO + size))
    parts = checked.select("row", stretch.alias("v"), across).select("row", "tile_col", F.slice("v", start + HALO + 1, size + 2 * HALO).alias("v"))
    dealt = parts.select("*", _homes(F.col("row"), size, "tile_row")).filter(F.col("tile_row") * size < rows)
    grouped = dealt.groupBy(*TILE).agg(F.map_from_entries(F.collect_list(F.struct((F.col("row") - F.col("tile_row") * size + HALO).cast("int").alias("k"), "v"))).alias("m"))
    nothing = F.array_repeat(F.lit(None).cast("double"), size + 2 * HALO)
    filled = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size + 2 * HALO - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), nothing)))
    return grouped.select(*(F.col(t).cast("long").alias(t) for t in TILE), filled.alias("values"))


def cells_of_tiles(tiles: DataFrame, shape: tuple[int, int], size: int = SIZE) -> DataFrame:
    """row, col, value of all cells of the shape that tiles hold, each once; null where the tile has none."""
    side, (rows, cols) = size + 2 * HALO, shape
    flat = tiles.select(*TILE, F.posexplode("values").alias("at", "value"))
    r, c = F.floor(F.col("at") / side) - HALO, F.col("at") % side - HALO
    own = flat.select((F.col("tile_row") * size + r).alias("row"), (F.col("tile_col") * size + c).alias("col"), "value", r.alias("_r"), c.alias("_c"))
    return own.filter(f"_r BETWEEN 0 AND {size - 1} AND _c BETWEEN 0 AND {size - 1} AND row < {rows} AND col < {cols}").select("row", "col", "value")


def cached_tiles(spark: SparkSession, path: str, cache: str, shape: tuple[int, int], size: int = SIZE) -> DataFrame:
    """Tiles of a text matrix, made once for each state of its files: the folder's name holds a digest of their names, sizes and times, and of the shape."""
    from ..sources.tables import matrix_lines

    files = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_micros("modificationTime").alias("t"))
    state = files.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", "path", "length", "t"))), F.lit(f"{shape}/{size}")), 256)).first()[0]
    place = f"{cache.rstrip('/')}/tiles-{state[:24]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):  # an unfinished folder is written anew
        tiles_of_lines(matrix_lines(spark, path, shape), shape, size).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def sample(points: DataFrame, tiles: DataFrame, shape: tuple[int, int], xmin: float, ymin: float, spacing: float, size: int = SIZE) -> DataFrame:
    """points (point_id, x, y and more) with surface_z, slope (degrees), curvature and dem_missing: one tile for each point.

    Values are bilinear at the point and one spacing to each side. Negative, non-finite and absent cells count as 0 and set dem_missing, as a side outside
    does; a point outside, or without a place, has nulls and dem_missing. Each row of points has one result."""
    rows, cols = shape
    side = size + 2 * HALO

    def at(dx: int, dy: int) -> tuple[Column, Column, Column]:
        """(within, row, column) of a place beside the point, in cells."""
        fc, fr = ((F.col(c) + d * spacing - low) / spacing for c, d, low in (("x", dx, xmin), ("y", dy, ymin)))
        return F.coalesce(is_finite(fc) & is_finite(fr) & fc.between(0, cols - 1) & fr.between(0, rows - 1), F.lit(False)), fr, fc

    within, fr, fc = at(0, 0)
    low = lambda f, n: F.least(F.floor(f), F.lit(n - 2))
    home = lambda f, n: F.when(within, F.floor(low(f, n) / size))
    placed = points.drop(*TILE, "values").withColumns({"_within": within, "_tile_row": home(fr, rows), "_tile_col": home(fc, cols)})
    met = placed.join(tiles.select(F.col("tile_row").alias("_tile_row"), F.col("tile_col").alias("_tile_col"), F.col("values").alias("_values")), ["_tile_row", "_tile_col"], "left")

    def value(dx: int, dy: int) -> tuple[Column, Column]:
        """(height, whether something was replaced by 0) of a place beside the point."""
        ok, r, c = at(dx, dy)
        r0, c0 = low(r, rows), low(c, cols)
        z, bad = F.lit(0.0), F.lit(False)
        for i in (0, 1):
            for j in (0, 1):
                cell = F.get("_values", ((r0 + i - F.col("_tile_row") * size + HALO) * side + c0 + j - F.col("_tile_col") * size + HALO).cast("int"))
                wrong = F.coalesce(~is_finite(cell) | (cell < 0), F.lit(True))
                weight = ((r - r0) if i else (1 - (r - r0))) * ((c - c0) if j else (1 - (c - c0)))
                z, bad = z + F.when(wrong, 0.0).otherwise(cell) * weight, bad | wrong
        return F.when(ok, z).otherwise(0.0), ~ok | bad

    places = {"c": (0, 0), "w": (-1, 0), "e": (1, 0), "s": (0, -1), "n": (0, 1)}
    found = {k: value(*d) for k, d in places.items()}
    valued = met.select(*points.columns, "_within", *(z.alias(f"_{k}") for k, (z, _) in found.items()), F.greatest(*(bad.cast("int") for _, bad in found.values())).alias("_bad"))
    e, w, n, s, c = (F.col(f"_{k}") for k in "ewnsc")
    slope = F.degrees(F.atan(F.hypot((e - w) / (2 * spacing), (n - s) / (2 * spacing))))
    curve = (e - 2 * c + w) / spacing**2 + (n - 2 * c + s) / spacing**2
    keep = lambda v: F.when(F.col("_within"), v)
    return valued.select(*points.columns, keep(c).alias("surface_z"), keep(slope).alias("slope"), keep(curve).alias("curvature"), ((F.col("_bad") == 1) | ~F.col("_within")).alias("dem_missing"))


def terrain(tiles: DataFrame, shape: tuple[int, int], spacing: float, size: int = SIZE) -> DataFrame:
    """row, col, surface_z, slope, curvature, dem_missing of every cell of the tiles: the values of `sample` on whole tiles, without a join. Places outside the
    shape count as 0, as negative, non-finite and absent cells do; dem_missing tells of the cell and its four neighbours."""
    side, (rows, cols) = size + 2 * HALO, shape
    names = ["row", "col", "surface_z", "slope", "curvature", "dem_missing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values in zip(batch.column("tile_row").to_pylist(), batch.column("tile_col").to_pylist(), batch.column("values"), strict=True):
                z = values.values.to_numpy(zero_copy_only=False).astype(float).reshape(side, side)
                bad = ~np.isfinite(z) | (z < 0)
                z = np.where(bad, 0.0, z)
                h, w = min(size, rows - i * size), min(size, cols - j * size)
                part = lambda a, dr, dc: a[HALO + dr : HALO + dr + h, HALO + dc : HALO + dc + w]  # noqa: B023, E731
                c, n, s, e, west = (part(z, *d) for d in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))
                slope = np.degrees(np.arctan(np.hypot((e - west) / (2 * spacing), (n - s) / (2 * spacing))))
                curve = (e - 2 * c + west) / spacing**2 + (n - 2 * c + s) / spacing**2
                missing = part(bad, 0, 0) | part(bad, 1, 0) | part(bad, -1, 0) | part(bad, 0, 1) | part(bad, 0, -1)
                r, col = np.mgrid[i * size : i * size + h, j * size : j * size + w]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).ravel()) for x in (r, col, c, slope, curve, missing)], names)

    return tiles.select(*TILE, "values").mapInArrow(run, "row long, col long, surface_z double, slope double, curvature double, dem_missing boolean")


def boundary_segments(tiles: DataFrame, shape: tuple[int, int], size: int = SIZE) -> DataFrame:
    """start_row, start_col, end_row, end_col: directed pieces of the lines at half level between active (non-zero) cells and others, in cells.

    Each square of four neighbouring cells lies in one tile and gives its pieces: from the middle of one side to the middle of another, with the active cells on
    the left. Where opposite corners are active the pieces keep them apart. Absent and non-finite cells aren't active; there is no square beyond the outer cells, so
    a line may end at the raster's edge."""
    side, (rows, cols) = size + 2 * HALO, shape
    names = ["start_row", "start_col", "end_row", "end_col"]
    # middles of a square's sides, in halves of a cell from its lower left corner (row, col): south, east, north, west
    middle = {"s": (0, 1), "e": (1, 2), "n": (2, 1), "w": (1, 0)}
    # active corners as bits (lower left 1, lower right 2, upper right 4, upper left 8): pieces from side to side
    pieces = {1: ["sw"], 2: ["es"], 3: ["ew"], 4: ["ne"], 5: ["sw", "ne"], 6: ["ns"], 7: ["nw"], 8: ["wn"], 9: ["sn"], 10: ["es", "wn"], 11: ["en"], 12: ["we"], 13: ["se"], 14: ["ws"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values in zip(batch.column("tile_row").to_pylist(), batch.column("tile_col").to_pylist(), batch.column("values"), strict=True):
                z = values.values.to_numpy(zero_copy_only=False).astype(float).reshape(side, side)
                on = (np.isfinite(z) & (z != 0)).astype(np.int64)
                h, w = min(size, rows - 1 - i * size), min(size, cols - 1 - j * size)
                if h < 1 or w < 1:
                    continue
                part = lambda dr, dc: on[HALO + dr : HALO + dr + h, HALO + dc : HALO + dc + w]  # noqa: B023, E731
                code = part(0, 0) + 2 * part(0, 1) + 4 * part(1, 1) + 8 * part(1, 0)
                out = []
                for k, lines in pieces.items():
                    r, c = np.nonzero(code == k)
                    if len(r):
                        base = np.stack([r + i * size, c + j * size], 1) * 2
                        out += [np.hstack([base + middle[a], base + middle[b]]) for a, b in lines]
                if out:
                    found = np.vstack(out) / 2
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, q])) for q in range(4)], names)

    return tiles.select(*TILE, "values").mapInArrow(run, "start_row double, start_col double, end_row double, end_col double")


def boundary_lines(segments: DataFrame) -> DataFrame:
    """line, position, row, col, closed: the points of each line in order, from pieces that meet end to end, however many tiles it crosses.

    Each point is the end of one piece at most and the start of one at most. Pointer jumping: in each round a point knows a piece's start twice as far
    back and how many steps lie between, so rounds grow with the logarithm of the longest line. A closed line begins at its least point (row, then column), which
    it has once; line is that first point as text."""
    point = lambda a: F.struct(F.col(f"{a}_row").alias("row"), F.col(f"{a}_col").alias("col"))
    links = written(segments.select(point("start").alias("a"), point("end").alias("b")).distinct(), "boundary-links")
    nodes = links.select(F.col("a").alias("p")).union(links.select("b")).distinct()
    before = links.select(F.col("b").alias("p"), F.col("a").alias("back"))
    # back: the point `reach` steps before, null where the line begins closer; least: the least point of those from it to p, least_at steps before p
    nothing = F.lit(0).cast("long")
    state = nodes.join(before, "p", "left").select("p", "back", F.col("p").alias("least"), nothing.alias("least_at"), F.when(F.col("back").isNull(), F.col("p")).alias("root"), nothing.alias("to_root"))
    n = links.count()
    reach = 1
    state = written(state, "boundary-state")
    while True:
        other = state.select(F.col("p").alias("back"), F.col("back").alias("b2"), F.col("root").alias("r2"), F.col("to_root").alias("t2"), F.col("least").alias("l2"), F.col("least_at").alias("a2"))
        met = state.join(other, "back", "left")
        jumped = F.col("back").isNotNull()
        nearer = jumped & (F.col("l2") < F.col("least"))
        state = written(met.select(
            "p", F.when(jumped & F.col("r2").isNull(), F.col("b2")).alias("back"), F.when(nearer, F.col("l2")).otherwise(F.col("least")).alias("least"),
            F.when(jumped, F.col("r2")).otherwise(F.col("root")).alias("root"), F.when(jumped & F.col("r2").isNotNull(), F.col("t2") + reach).otherwise(F.col("to_root")).alias("to_root"),
            F.when(nearer, F.col("a2") + reach).otherwise(F.col("least_at")).alias("least_at"),
        ), "boundary-state")
        reach *= 2
        if reach > 2 * n or not state.filter("root IS NULL").limit(1).count():
            break
        if reach > 2 and not state.filter("root IS NULL").join(state.select("p", "least").toDF("q", "m"), (F.col("back") == F.col("q")) & (F.col("least") != F.col("m"))).limit(1).count():
            break  # only closed lines are left, and all their points know the least
    closed = F.col("root").isNull()
    # a closed line's points count their steps from its least point, the last time they passed it
    first = F.when(closed, F.col("least")).otherwise(F.col("root"))
    position = F.when(closed, F.col("least_at")).otherwise(F.col("to_root"))
    return state.select(F.concat_ws(",", first["row"], first["col"]).alias("line"), position.alias("position"), F.col("p.row").alias("row"), F.col("p.col").alias("col"), closed.alias("closed"))
