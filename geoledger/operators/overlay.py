"""Areas of polygons, of their unions and of overlays of two layers, cell by cell: what overlaps counts once, by geometry and not by counting points.

`spatial.cell_index` deals edges to cells. Inside a cell the plane is cut into level strips at all corners, crossings and sides, so that in a strip no two edges
cross; the covered length at a strip's middle times its height is its area exactly, but for rounding. Shapes that look alike in a cell are one there, and
where a value covers a whole cell its other shapes tell nothing. Cells in which a value still has many edges are cut in four, as often
as needed, before their edges meet in a task, so neither a crowded cell nor a long outline is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import spatial

#: Edges of a cell above which it is cut in four, and how often that is done: edges that all lie on one another are never parted.
MOST_EDGES, DEEPEST = 128, 16
#: Strips of a cell that are measured at once, and cells whose edges are unpacked at once.
STRIPS, CELLS = 1024, 64
Bounds = tuple[float, float, float, float]


def _sides(cell: float) -> tuple[Column, Column, Column]:
    """A cell's side, left and lower border."""
    side = cell / F.pow(F.lit(2.0), F.col("level"))
    return side, F.col("cx") * side, F.col("cy") * side


def _touches(e: Column, x0: Column, y0: Column, side: Column) -> Column:
    """Whether an edge may touch a closed cell; never false where it does."""
    slack = side * 1e-9
    size = (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])) * slack
    turns = [spatial._turn(e, x0 + i * side, y0 + j * side) for i in (0, 1) for j in (0, 1)]
    box = (F.greatest(e["x1"], e["x2"]) >= x0 - slack) & (F.least(e["x1"], e["x2"]) <= x0 + side + slack) & (F.greatest(e["y1"], e["y2"]) >= y0 - slack) & (F.least(e["y1"], e["y2"]) <= y0 + side + slack)
    return box & (F.least(*turns) <= size) & (F.greatest(*turns) >= -size)


def _quarters(cells: DataFrame, cell: float) -> DataFrame:
    """Each cell's four quarters, with the edges that touch them and their own corners."""
    side, x0, y0 = _sides(cell)
    quarters = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    rest = [c for c in cells.columns if c not in ("level", "cx", "cy", "edges", "corner")]
    cut = cells.withColumns({"_x1": x0 + side, "_y0": y0, "_q": quarters})
    cut = cut.select(*rest, (F.col("level") + 1).alias("level"), (F.col("cx") * 2 + F.col("_q.i")).alias("cx"), (F.col("cy") * 2 + F.col("_q.j")).alias("cy"), "edges", "corner", "_x1", "_y0")
    side, x0, y0 = _sides(cell)
    corner = F.when(F.col("edges").isNull(), True).otherwise(spatial._inside(F.col("edges"), F.col("corner"), x0 + side, y0, F.col("_x1"), F.col("_y0")))
    mine = F.filter("edges", lambda e: _touches(e, x0, y0, side))
    cut = cut.withColumns({"_corner": corner, "_edges": mine}).filter("_corner OR size(_edges) > 0")
    return cut.select(*rest, "level", "cx", "cy", F.when(F.size("_edges") > 0, F.col("_edges")).alias("edges"), F.col("_corner").alias("corner"))


def _seen(e: Column, x0: Column, y0: Column, side: Column) -> Column:
    """An edge as its cell sees it: upright and level ones end a side beyond the cell, which changes none of their answers there, exactly."""
    end = lambda v, low: F.greatest(low - side, F.least(low + 2 * side, v))
    of = lambda *c: F.struct(*(v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)))
    upright = of(e["x1"], end(F.least(e["y1"], e["y2"]), y0), e["x2"], end(F.greatest(e["y1"], e["y2"]), y0))
    level = of(end(F.least(e["x1"], e["x2"]), x0), e["y1"], end(F.greatest(e["x1"], e["x2"]), x0), e["y2"])
    return F.when(e["x1"] == e["x2"], upright).when(e["y1"] == e["y2"], level).otherwise(of(e["x1"], e["y1"], e["x2"], e["y2"]))


def _distinct(cells: DataFrame, cell: float, by: list[str]) -> DataFrame:
    """level, cx, cy, by, edges, corner: the different shapes of each value in each cell; only the whole cell where one of them covers it."""
    key, (side, x0, y0) = ["level", "cx", "cy"], _sides(cell)
    seen = F.sort_array(F.transform("edges", lambda e: _seen(e, x0, y0, side)))
    cells = written(cells.select(*key, *by, F.when(F.col("edges").isNotNull(), seen).alias("edges"), "corner").distinct(), "overlay-shapes").hint("merge")
    names = [*key, *by]
    whole = cells.filter("edges IS NULL").select(*(F.col(c).alias(f"_{c}") for c in names)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c in by else F.col(c) == F.col(f"_{c}") for c in names]
    return cells.filter("edges IS NULL").unionByName(cells.filter("edges IS NOT NULL").join(whole, same, "left_anti"))


def refined(index: DataFrame, cell: float, most: int = MOST_EDGES, by: Sequence[str] = ("code",)) -> DataFrame:
    """A cell index with `level`: cells of side cell / 2^level, in none of which a value of `by` has many edges. Shapes lose their poly_id; see `_distinct`."""
    key, by, parts = ["level", "cx", "cy"], list(by), []
    rest = written(_distinct(index.withColumn("level", F.lit(0)), cell, by), "overlay-cells").hint("merge")
    for _ in range(DEEPEST):
        crowded = rest.groupBy(*key, *by).agg(F.sum(F.coalesce(F.size("edges"), F.lit(0))).alias("n")).filter(F.col("n") > most).select(*key).distinct()
        crowded = written(crowded, "overlay-crowded")
        if not crowded.limit(1).count():
            break
        parts.append(rest.join(crowded, key, "left_anti"))
        rest = written(_distinct(_quarters(rest.join(crowded, key, "left_semi"), cell), cell, by), "overlay-cells").hint("merge")
    out = rest
    for p in parts:
        out = out.unionByName(p)
    return out


def _index(polygons: DataFrame, cell: float) -> DataFrame:
    """The cell index, made by all cores: a small file of polygons is one task's, and its edges in cells are many more."""
    spread = polygons.select("poly_id", "code", "rings").repartition(4 * polygons.sparkSession.sparkContext.defaultParallelism)
    return spatial.cell_index(spread, cell)


class Shape:
    """A polygon in a rectangle: its edges there and whether the lower right corner is inside."""

    def __init__(self, edges: list[dict], corner: bool, place: tuple[float, float], to: tuple[float, float]):
        self.e = np.array([(e["x1"], e["y1"], e["x2"], e["y2"]) for e in edges]).reshape(-1, 4)
        if place != to:
            (x1, y0), (x, y) = place, to
            across = self.spans(1, y) & (self.right(x, y) != self.right(x1, y))
            down = self.spans(0, x1) & (self.above(x1, y0) != self.above(x1, y))
            corner ^= bool((across.sum() + down.sum()) % 2)
        self.corner = corner

    @classmethod
    def of(cls, e: np.ndarray) -> Shape:
        shape = cls([], False, (0.0, 0.0), (0.0, 0.0))
        shape.e = e
        return shape

    def spans(self, axis: int, at: float | np.ndarray) -> np.ndarray:
        return (self.e[:, axis] > at) != (self.e[:, axis + 2] > at)

    def turn(self, x: float, y: float | np.ndarray) -> np.ndarray:
        a, b, c, d = self.e.T
        return (c - a) * (y - b) - (d - b) * (x - a)

    def right(self, x: float, y: float | np.ndarray) -> np.ndarray:
        return np.where(self.e[:, 3] > self.e[:, 1], self.turn(x, y) > 0, self.turn(x, y) < 0)

    def above(self, x: float, y: float | np.ndarray) -> np.ndarray:
        t, up = self.turn(x, y), self.e[:, 3] - self.e[:, 1]
        return np.where(self.e[:, 2] > self.e[:, 0], (t < 0) | ((t == 0) & (up > 0)), (t > 0) | ((t == 0) & (up < 0)))


def _levels(e: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Heights between which no edge begins, ends, crosses another or passes a side."""
    a, b, c, d = e.T
    found = [np.array([y0, y1]), b, d]
    with np.errstate(divide="ignore", invalid="ignore"):
        found += [b + (x - a) * (d - b) / (c - a) for x in (x0, x1)]
        dx, dy = c - a, d - b
        cross = dx[:, None] * dy - dy[:, None] * dx
        t = ((a - a[:, None]) * dy - (b - b[:, None]) * dx) / cross
        meet = b[:, None] + t * dy[:, None]
        found.append(meet[(t >= 0) & (t <= 1) & np.isfinite(meet)])
    y = np.concatenate(found)
    return np.unique(np.clip(y[np.isfinite(y)], y0, y1))


def covered(layers: list[list[Shape]], x0: float, y0: float, x1: float, y1: float) -> float:
    """The area of a rectangle that some shape of each layer covers."""
    shapes = [s for layer in layers for s in layer]
    layer = np.repeat(np.arange(len(layers)), [len(v) for v in layers])
    owner = np.repeat(np.arange(len(shapes)), [len(s.e) for s in shapes])
    all_ = Shape.of(np.concatenate([s.e for s in shapes]))
    mine, theirs = (owner[:, None] == np.arange(len(shapes))).astype(float), (layer[:, None] == np.arange(len(layers))).astype(float)
    corner, (a, b, c, d) = np.array([s.corner for s in shapes]), all_.e.T
    levels, total = _levels(all_.e, x0, y0, x1, y1), 0.0
    for first in range(0, len(levels) - 1, STRIPS):
        part = levels[first : first + STRIPS + 1]
        height, y = np.diff(part), ((part[:-1] + part[1:]) / 2)[:, None]
        # which shapes hold a strip's right end, and where their edges cross its middle from there to the left
        down = all_.spans(0, x1) & (all_.above(x1, y0) != all_.above(x1, y))
        inside = corner ^ ((down @ mine) % 2 == 1)
        strip, e = np.nonzero(all_.spans(1, y) & ~all_.right(x1, y))
        x = np.minimum(a[e] + (y[strip, 0] - b[e]) * (c[e] - a[e]) / (d[e] - b[e]), x1)
        strip, e, x = strip[x > x0], e[x > x0], x[x > x0]
        order = np.lexsort((-x, owner[e], strip))
        strip, shape, x = strip[order], owner[e][order], x[order]
        begins = np.flatnonzero(np.r_[True, (strip[1:] != strip[:-1]) | (shape[1:] != shape[:-1])][: len(x)])
        turn = np.arange(len(x)) - np.repeat(begins, np.diff(np.r_[begins, len(x)]))
        change = np.where(inside[strip, shape] ^ (turn % 2 == 1), -1.0, 1.0)
        # how many shapes of each layer hold what lies left of each crossing
        order = np.lexsort((-x, strip))
        strip, x, steps = strip[order], x[order], (change[:, None] * theirs[shape])[order]
        start, sums = inside @ theirs, np.cumsum(steps, 0)
        at = np.searchsorted(strip, np.arange(len(height)))
        before = np.vstack([np.zeros((1, len(layers))), sums])[at]
        held = ((sums - before[strip] + start[strip]) > 0.5).all(1)
        last = np.r_[strip[1:] != strip[:-1], True][: len(x)]
        to = np.where(last, x0, np.r_[x[1:], x0][: len(x)])
        left = np.bincount(strip, np.where(held, x - to, 0.0), len(height))
        has = np.bincount(strip, minlength=len(height)) > 0
        begin = np.full(len(height), x0)
        begin[has] = x[at[has]]
        total += float(height @ (left + np.where((start > 0.5).all(1), x1 - begin, 0.0)))
    return total


def _measured(cells: DataFrame, keys: list[str], layers: list[str], cell: float, bounds: Bounds | None) -> DataFrame:
    """keys and area of cells whose columns `layers` hold shapes (corner, edges); a null layer covers the whole cell."""
    schema = cells.select(*keys).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = []
            for row in (r for at in range(0, batch.num_rows, CELLS) for r in batch.slice(at, CELLS).select(["level", "cx", "cy", *layers]).to_pylist()):
                side = cell / 2.0 ** row["level"]
                x0, y0 = row["cx"] * side, row["cy"] * side
                place, (x1, y1) = (x0 + side, y0), (x0 + side, y0 + side)
                if bounds:
                    x0, y0, x1, y1 = max(x0, bounds[0]), max(y0, bounds[1]), min(x1, bounds[2]), min(y1, bounds[3])
                given = [row[c] for c in layers if row[c] is not None]
                if x0 >= x1 or y0 >= y1:
                    areas.append(0.0)
                elif not given:
                    areas.append((x1 - x0) * (y1 - y0))
                else:
                    areas.append(covered([[Shape(s["edges"], s["corner"], place, (x1, y0)) for s in layer] for layer in given], x0, y0, x1, y1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(areas, pa.float64())], [*keys, "area"])

    return cells.mapInArrow(run, f"{schema}, area double")


def _layer(cells: DataFrame, keys: list[str], name: str) -> DataFrame:
    """level, cx, cy, keys and one column of the distinct shapes there; null where a shape covers the whole cell."""
    grouped = cells.groupBy("level", "cx", "cy", *keys).agg(F.bool_or(F.col("edges").isNull()).alias("_full"), F.collect_set(F.when(F.col("edges").isNotNull(), F.struct("corner", "edges"))).alias(name))
    return grouped.withColumn(name, F.when(~F.col("_full"), F.col(name))).drop("_full")


def union_areas(polygons: DataFrame, cell: float, by: str | None = "code", bounds: Bounds | None = None, most: int = MOST_EDGES) -> DataFrame:
    """`by` and area: what the polygons (poly_id, code, rings) of each value cover together, within bounds (xmin, ymin, xmax, ymax) if given. by=None: one row
    for all of them. Values that cover nothing within the bounds have area 0; a null value is one of its own; no polygons give no rows (by=None: a null area)."""
    index = _index(polygons, cell)
    if bounds:
        index = index.filter((F.col("cx") * cell < bounds[2]) & ((F.col("cx") + 1) * cell > bounds[0]) & (F.col("cy") * cell < bounds[3]) & ((F.col("cy") + 1) * cell > bounds[1]))
    shapes = _layer(refined(index, cell, most, [by] if by else []), [by] if by else [], "shapes")
    if not by:
        return _measured(shapes.withColumn("_all", F.lit(1)), ["_all"], ["shapes"], cell, bounds).agg(F.sum("area").alias("area"))
    values = polygons.filter(F.exists(spatial._edges(F.col("rings")), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))).select(by, F.lit(0.0).alias("area"))
    return _measured(shapes, [by], ["shapes"], cell, bounds).unionByName(values).groupBy(by).agg(F.sum("area").alias("area"))


def overlay_areas(a: DataFrame, b: DataFrame, cell: float, bounds: Bounds | None = None, most: int = MOST_EDGES) -> DataFrame:
    """code_a, code_b, area: what polygons of both codes cover, for each pair that shares a cell and some area."""
    of = lambda df, layer: _index(df, cell).withColumn("layer", F.lit(layer))
    index = written(refined(of(a, 0).unionByName(of(b, 1)), cell, most, ["layer", "code"]), "overlay-index")
    left = _layer(index.filter("layer = 0").withColumnRenamed("code", "code_a"), ["code_a"], "shapes_a")
    right = _layer(index.filter("layer = 1").withColumnRenamed("code", "code_b"), ["code_b"], "shapes_b")
    both = left.hint("merge").join(right, ["level", "cx", "cy"])
    return _measured(both, ["code_a", "code_b"], ["shapes_a", "shapes_b"], cell, bounds).groupBy("code_a", "code_b").agg(F.sum("area").alias("area")).filter("area > 0")


def area_fractions(polygons: DataFrame, cell: float, bounds: Bounds) -> DataFrame:
    """code, area, fraction_of_bounds, fraction_of_covered: a code's share of a rectangle, and of what the polygons of all codes cover there."""
    everything = union_areas(polygons, cell, None, bounds).withColumnRenamed("area", "_covered")  # one row
    rectangle = (bounds[2] - bounds[0]) * (bounds[3] - bounds[1])
    out = union_areas(polygons, cell, "code", bounds).join(F.broadcast(everything))
    return out.select("code", "area", (F.col("area") / rectangle).alias("fraction_of_bounds"), F.when(F.col("_covered") > 0, F.col("area") / F.col("_covered")).alias("fraction_of_covered"))
