"""Joins with checked cardinality, exclusions, and joins by distance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from . import pyramid
from .ledger import assert_unique


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one", flag: str | None = "matched") -> DataFrame:
    """A join whose "one" sides are checked first, by jobs that run while the plan is built. flag: whether a left row found its match."""
    if validate.split("_to_")[0] == "one":
        assert_unique(left, on, "left side")
    if validate.split("_to_")[1] == "one":
        assert_unique(right, on, "right side")
    if flag:
        return left.join(right.withColumn(flag, F.lit(True)), list(on), how).withColumn(flag, F.coalesce(flag, F.lit(False)))
    return left.join(right, list(on), how)


def exclude_heldout(candidates: DataFrame, heldout: DataFrame, key: str = "boring_id") -> DataFrame:
    """Drops candidates with a held-out id or exactly at a held-out place; near ones stay."""
    return candidates.join(heldout.select(key), key, "left_anti").join(heldout.select("x", "y"), ["x", "y"], "left_anti")


def exclude_near(rows: DataFrame, heldout: DataFrame, tolerance: float, key: str = "boring_id") -> DataFrame:
    """Drops every row of a hole within the tolerance of a held-out point; an empty held-out table drops nothing. Whether one is there is all that's asked."""
    near = pyramid.nearest_within(rows.select(key, "x", "y"), heldout.select(F.lit(0).alias("_held"), "x", "y"), tolerance, key, "_held")
    return rows.join(near.select(key), key, "left_anti")


def nearest_reference(points: DataFrame, references: DataFrame, radius: float, key: str, reference_key: str, itself: bool = True) -> DataFrame:
    """For each point: the nearest reference within the radius, its distance, and how many are within it. Unless `itself`, a
    reference with the point's own key doesn't count."""
    nearest = pyramid.nearest_within(points, references, radius, key, reference_key, itself)
    counts = pyramid.radius_counts(points, references, radius, key, reference_key, itself).groupBy(key).agg(F.sum("n_within").alias("n_within"))
    found = points.select(key).hint("merge").join(nearest, key, "left").join(counts.hint("merge"), key, "left")  # as many rows as points, see pyramid
    return found.select(key, f"nearest_{reference_key}", "nearest_distance", F.coalesce("n_within", F.lit(0)).alias("n_within"))


def select_nearest(rows: DataFrame, keys: Sequence[str], position: Column, target: float, tolerance: float, value: str, tie: float = 1e-9) -> DataFrame:
    """Per key the rows nearest to the target within an inclusive tolerance; ties are averaged."""
    inside = rows.withColumns({"position": position, "gap": F.abs(position - target)}).filter(F.col("gap") <= tolerance)
    best = inside.withColumn("least", F.min("gap").over(Window.partitionBy(*keys))).filter(F.col("gap") - F.col("least") <= tie)
    return best.groupBy(*keys).agg(F.avg(value).alias("value"), F.avg("position").alias("position"), F.min("position").alias("least_position"), F.max("position").alias("most_position"), F.count("*").alias("samples"))


def crosswalk(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every code of either side, with presence flags."""
    one = left.select(key).distinct().withColumn("in_left", F.lit(True))
    other = right.select(key).distinct().withColumn("in_right", F.lit(True))
    return one.join(other, key, "full").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: new values win, fields that are null in the new row keep the old value."""
    columns = [c for c in dict.fromkeys(old.columns + new.columns) if c != key]
    o, n = old.alias("o"), new.alias("n")
    side = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, df in (("n", new), ("o", old)) if c in df.columns)).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(side(c) for c in columns))


def require_all_matched(left: DataFrame, right: DataFrame, on: Sequence[str], what: str = "rows") -> DataFrame:
    """left joined one to one with right; raises if a row of left has no match or a key repeats."""
    assert_unique(left, on, "left side")
    assert_unique(right, on, "right side")
    if left.join(right, list(on), "left_anti").limit(1).count():
        raise ValueError(f"{what} without a match")
    return left.join(right, list(on))


def nearest_at_all(points: DataFrame, references: DataFrame, radius: float, key: str, reference_key: str) -> DataFrame:
    """key, nearest_<reference_key>, nearest_distance of the nearest reference however far it is: within the radius, then within four times
    it and so on, until no point is left; each round takes only points that have none within its radius yet. Runs jobs while the plan is built."""
    left, parts, r = points.select(key, "x", "y").distinct(), [], radius
    ends = references.select("x", "y").unionByName(left.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    span = None if ends is None or ends[0] is None else (ends[0] ** 2 + ends[1] ** 2) ** 0.5
    if span is None or not references.limit(1).count():
        return left.select(key, F.lit(None).cast(references.schema[reference_key].dataType).alias(f"nearest_{reference_key}"), F.lit(None).cast("double").alias("nearest_distance"))
    while True:
        found = written(pyramid.nearest_within(left, references, r, key, reference_key), "nearest")
        parts.append(found)
        if r > span:
            return reduce(DataFrame.unionByName, parts)
        left = written(left.join(found, key, "left_anti"), "far")
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, parts)
        r *= 4


def depth_gap(queries: DataFrame, nearest: DataFrame, measurements: DataFrame, key: str, hole: str) -> DataFrame:
    """key and n_nearest_hole_depth_gap: from the query's depth to the closest measured depth of its nearest hole."""
    both = queries.select(key, "depth").join(nearest.select(key, F.col(f"nearest_{hole}").alias(hole)), key).join(measurements.select(hole, F.col("depth").alias("_d")), hole)
    return both.groupBy(key).agg(F.min(F.abs(F.col("_d") - F.col("depth"))).alias("n_nearest_hole_depth_gap"))
