"""Points in polygons, without a geometry library: cells of a grid hold the edges that touch them, and those decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edges(rings: Column) -> Column:
    """All edges of all rings (arrays of (x, y), closed or not) as structs."""
    return F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(F.get(r, i)["x"].alias("x1"), F.get(r, i)["y"].alias("y1"), F.get(r, F.pmod(i + 1, F.size(r)))["x"].alias("x2"), F.get(r, F.pmod(i + 1, F.size(r)))["y"].alias("y2")))))


def _turn(e: Column, x: Column, y: Column) -> Column:
    """On which side of an edge a place lies. All tests below take their answers from this one number's sign, so they never contradict one another."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _right_of(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge that crosses height y does so to the right of x."""
    return F.when(e["y2"] > e["y1"], _turn(e, x, y) > 0).otherwise(_turn(e, x, y) < 0)


def _above(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge that crosses the upright just right of x does so above y; where it passes through the place itself, it does if it rises."""
    t, up = _turn(e, x, y), e["y2"] - e["y1"]
    return F.when(e["x2"] > e["x1"], (t < 0) | ((t == 0) & (up > 0))).otherwise((t > 0) | ((t == 0) & (up < 0)))


def _on_edge(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda e: (_turn(e, x, y) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))


def _spans_y(e: Column, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def cell_index(polygons: DataFrame, cell: float) -> DataFrame:
    """cx, cy, poly_id, code, edges, corner: the square cells that polygons (poly_id, code, rings) touch or cover.

    A boundary cell holds only the edges that touch it, and in `corner` whether its lower right corner is inside; a cell wholly inside has no edges (null). Cells
    outside have no row. Holes and parts count alike, by the even-odd rule; rows that share poly_id and code are one shape.

    Each edge is dealt to its cells by the rows of cells it passes, so no row ever holds a whole outline. Corners follow from the edges that cross the lower
    side of each cell to their right: one sum along each row of a polygon's cells."""
    slack = cell * 1e-9
    at = lambda c: F.floor(c / cell)
    edges = polygons.select("poly_id", "code", F.explode(_edges(F.col("rings"))).alias("e"))
    edges = edges.filter("e.x1 <> e.x2 OR e.y1 <> e.y2")
    e = F.col("e")
    lo, hi = (lambda a: F.least(e[f"{a}1"], e[f"{a}2"])), (lambda a: F.greatest(e[f"{a}1"], e[f"{a}2"]))
    rows = edges.withColumn("cy", F.explode(F.sequence(at(lo("y") - slack), at(hi("y") + slack))))
    # where the edge enters and leaves the row of cells
    x_at = lambda y: F.greatest(lo("x"), F.least(hi("x"), e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    bottom, top = F.greatest(lo("y"), F.col("cy") * cell - slack), F.least(hi("y"), (F.col("cy") + 1) * cell + slack)
    level = e["y1"] == e["y2"]
    left, right = F.when(level, lo("x")).otherwise(F.least(x_at(bottom), x_at(top))), F.when(level, hi("x")).otherwise(F.greatest(x_at(bottom), x_at(top)))
    # a little more than the edge takes, as its places are rounded: an edge too many in a cell changes nothing
    more = slack + (right - left) * 1e-9
    dealt = rows.withColumn("cx", F.explode(F.sequence(at(left - more), at(right + more))))
    x0, x1, y0 = F.col("cx") * cell, (F.col("cx") + 1) * cell, F.col("cy") * cell
    crossing = (_spans_y(e, y0) & (_right_of(e, x0, y0) != _right_of(e, x1, y0))).cast("int")
    cells = dealt.withColumn("crossing", crossing).groupBy("poly_id", "code", "cy", "cx").agg(F.collect_list("e").alias("edges"), F.sum("crossing").alias("crossings"))
    row = Window.partitionBy("poly_id", "code", "cy").orderBy(F.desc("cx"))
    cells = cells.withColumns({"_sum": F.sum("crossings").over(row.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.lag("cx").over(row)})
    cells = cells.withColumn("corner", F.coalesce("_sum", F.lit(0)) % 2 == 1)
    # a gap in the row has no edges: it is inside if the corner before it is
    gap = F.filter(F.sequence(F.col("cx"), F.col("_next")), lambda c: (c > F.col("cx")) & (c < F.col("_next")))
    covered = cells.filter("corner AND _next > cx + 1").select("poly_id", "code", "cy", F.explode(gap).alias("cx"))
    boundary = cells.select("cx", "cy", "poly_id", "code", "edges", "corner")
    return boundary.unionByName(covered.select("cx", "cy", "poly_id", "code", F.lit(None).cast(boundary.schema["edges"].dataType).alias("edges"), F.lit(True).alias("corner")))


def _inside(edges: Column, corner: Column, x: Column, y: Column, x1: Column, y0: Column) -> Column:
    """From a place right to its cell's side, then down to the lower right corner: each edge on the way changes between inside and outside."""
    across = lambda e: _spans_y(e, y) & (_right_of(e, x, y) != _right_of(e, x1, y))
    down = lambda e: ((e["x1"] > x1) != (e["x2"] > x1)) & (_above(e, x1, y0) != _above(e, x1, y))
    return (F.size(F.filter(edges, across)) + F.size(F.filter(edges, down)) + corner.cast("int")) % 2 == 1


def candidates(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs of a point (point_id, x, y) and a polygon (poly_id, code, rings, or their `cell_index`) that holds it: inside, on_boundary."""
    index = polygons if "corner" in polygons.columns else cell_index(polygons, cell)
    placed = points.select("point_id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    both = placed.join(index.select("cx", "cy", "poly_id", "code", "edges", "corner"), ["cx", "cy"])
    x, y, boundary = F.col("x"), F.col("y"), F.col("edges").isNotNull()
    both = both.withColumn("on_boundary", boundary & _on_edge(F.col("edges"), x, y))
    inside = _inside(F.col("edges"), F.col("corner"), x, y, (F.col("cx") + 1) * cell, F.col("cy") * cell)
    both = both.withColumn("inside", ~F.col("on_boundary") & F.when(boundary, inside).otherwise(True))
    return both.filter("inside OR on_boundary").select("point_id", "poly_id", "code", "inside", "on_boundary")


def first_match(points: DataFrame, polygons: DataFrame, cell: float, fallback: bool = False) -> DataFrame:
    """One row for each point: the lowest poly_id that strictly holds it, else (fallback) the lowest that touches it; match_method."""
    found = candidates(points, polygons, cell)
    found = found if fallback else found.filter("inside")
    best = found.groupBy("point_id").agg(F.min(F.struct(F.col("on_boundary"), F.col("poly_id"), F.col("code"))).alias("m"))
    method = F.when(F.col("m").isNull(), "unmatched").when(F.col("m.on_boundary"), "intersects").otherwise("within")
    return points.select("point_id").join(best, "point_id", "left").select("point_id", F.col("m.poly_id").alias("poly_id"), F.col("m.code").alias("code"), method.alias("match_method"))


def agreed_code(points: DataFrame, polygons: DataFrame, cell: float, unknown: str = "UNKNOWN") -> DataFrame:
    """One row for each point: the code that all polygons strictly holding it share; unknown where they conflict or none does."""
    found = candidates(points, polygons, cell).filter("inside").groupBy("point_id").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    code = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(unknown)
    return points.select("point_id").join(found, "point_id", "left").select("point_id", code.alias("code"))


def ring_area(ring: Column) -> Column:
    """Unsigned area by the shoelace formula."""
    at = lambda i, c: F.get(ring, F.pmod(i, F.size(ring)))[c]
    return F.abs(F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0.0), lambda s, i: s + at(i, "x") * at(i + 1, "y") - at(i + 1, "x") * at(i, "y"))) / 2
