"""Connected components of a graph held as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges (a, b).

    Large-star and small-star steps until nothing changes: each node's neighbours move to its least neighbour. Rounds grow with
    the logarithm of the nodes; a node with very many neighbours is one row on the other side of a join, so it may be split."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "stars")
        if (now := state()) == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select("v", "v").distinct())
        before = now


def neighboured(cells: DataFrame) -> DataFrame:
    """cx, cy of the cells that may have another within two steps: each two such cells share a block of eight by eight in one of four grids of blocks. Where places lie
    far apart these are few, and only they are dealt to the cells around."""
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 4) for j in (0, 4)))).alias("s")
    block = [F.floor((F.col(c) + F.col(f"s.{s}")) / 8).alias(f"b{c}") for c, s in (("cx", "i"), ("cy", "j"))]
    full = cells.select("cx", "cy", shift).groupBy("s", *block).agg(F.collect_list(F.struct("cx", "cy")).alias("c")).filter(F.size("c") > 1)  # 64 at most
    return full.select(F.explode("c").alias("c")).select("c.cx", "c.cy").distinct()


def location_groups(points: DataFrame, tolerance: float, key: str = "boring_id") -> DataFrame:
    """key, location (the smallest key of its component): keys whose median places are linked by steps within the tolerance.

    In a cell of tolerance / sqrt(2) all places are within the tolerance of each other, so they are one node, the cell, however many they
    are. Neighbouring cells need one link: it is sought among one place for each of 64 parts of a cell; only cells without a link among those compare all
    their places, as far as these lie within the tolerance of the other cell."""
    sites = points.groupBy(key).agg(F.median("x").alias("x"), F.median("y").alias("y"))
    side = tolerance / 2**0.5
    cell = lambda c, parts=1: F.floor(F.col(c) / (side / parts))
    # places pack well in files: their size there tells nothing of a broadcast's
    placed = written(sites.withColumns({"cx": cell("x"), "cy": cell("y")}), "places").hint("merge")
    cells = placed.groupBy("cx", "cy").agg(F.min(key).alias("least"))
    places = written(placed.join(cells, ["cx", "cy"]).select("cx", "cy", "least", "x", "y").distinct(), "places").hint("merge")
    all_cells, near_cells = cells, written(neighboured(places.select("cx", "cy").distinct()), "cells")
    places, cells = (written(df.join(near_cells, ["cx", "cy"], "left_semi"), "places").hint("merge") for df in (places, cells))
    # half of the cells around, so that each two cells meet once
    steps = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0))))
    beside = lambda df, *names: df.select("cx", "cy", F.col("least").alias("a"), *names, steps.alias("s")).select((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), "a", *names)
    near = F.sqrt((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2) <= tolerance
    links = lambda other, those: other.join(those, ["cx", "cy"]).filter(near).select("a", F.col("least").alias("b")).distinct()
    own = lambda df: df.withColumns({"ax": F.col("x"), "ay": F.col("y")})
    some = places.groupBy("cx", "cy", "least", cell("x", 8), cell("y", 8)).agg(F.min(F.struct("x", "y")).alias("p")).select("cx", "cy", "least", "p.x", "p.y")
    first = written(links(beside(own(some), "ax", "ay"), some), "links")
    unlinked = beside(cells).join(cells.withColumnRenamed("least", "b"), ["cx", "cy"]).join(first, ["a", "b"], "left_anti")
    gap = lambda c, at: F.greatest(F.col(at) * side - F.col(c), F.col(c) - (F.col(at) + 1) * side, F.lit(0.0))
    within = gap("ax", "cx") ** 2 + gap("ay", "cy") ** 2 <= tolerance**2 * (1 + 1e-6)
    rest = links(beside(own(places), "ax", "ay").filter(within).join(unlinked.select("a", "cx", "cy"), ["a", "cx", "cy"]), places)
    found = components(first.unionByName(rest)).select(F.col("node").alias("least"), "component")
    return placed.join(all_cells, ["cx", "cy"]).join(found, "least", "left").select(key, F.coalesce("component", "least").alias("location"))
