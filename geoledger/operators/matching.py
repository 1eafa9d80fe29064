"""Interval matching of samples to measurements of the same place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..storage import written
from .joins import nearest_reference


def match_intervals(samples: DataFrame, measurements: DataFrame, xy_tolerance: float, depth_tolerance: float) -> DataFrame:
    """samples: sample_id, x, y, depth, depth_top, depth_bottom; measurements: hole_id, x, y, depth, n_value, measurement_no.

    A sample needs exactly one hole within xy_tolerance. With both interval ends the mean is over measurements in the interval,
    else over those at its depth, ends widened by depth_tolerance. Outcomes: no_matching_hole, ambiguous_hole,
    invalid_sample_interval, interval_mean, exact_depth_mean, no_spt_in_interval. The nearest measurement is diagnostic only."""
    holes = measurements.groupBy("hole_id").agg(F.min_by(F.struct("x", "y"), "measurement_no").alias("p")).select("hole_id", "p.*")
    holes = written(holes, "interval-holes")  # the search reads them several times
    near = nearest_reference(samples.select("sample_id", "x", "y"), holes, xy_tolerance, "sample_id", "hole_id")
    near = near.select("sample_id", F.col("n_within").alias("candidate_holes"), F.col("nearest_hole_id").alias("hole_id"))
    given = samples.join(near, "sample_id", "left").withColumn("candidate_holes", F.coalesce("candidate_holes", F.lit(0)))
    both = F.col("depth_top").isNotNull() & F.col("depth_bottom").isNotNull()
    bad = both & ~(is_finite(F.col("depth_top")) & is_finite(F.col("depth_bottom")) & (F.col("depth_top") >= 0) & (F.col("depth_bottom") >= F.col("depth_top")))
    given = given.withColumns({"hole_id": F.when(F.col("candidate_holes") == 1, F.col("hole_id")), "has_interval": both, "bad_interval": F.coalesce(bad, F.lit(False))})
    values = measurements.select("hole_id", F.col("depth").alias("m_depth"), "n_value", "measurement_no")
    paired = given.select("sample_id", "hole_id", "depth", "depth_top", "depth_bottom", "has_interval", "bad_interval").join(values, "hole_id")
    gap = F.abs(F.col("m_depth") - F.col("depth"))
    chosen = ~F.col("bad_interval") & F.when(F.col("has_interval"), F.col("m_depth").between(F.col("depth_top") - depth_tolerance, F.col("depth_bottom") + depth_tolerance)).otherwise(gap <= depth_tolerance)
    of = lambda c: F.when(chosen, c)
    found = paired.groupBy("sample_id").agg(
        F.avg(of(F.col("n_value"))).alias("n_measured"),
        F.count_if(chosen).alias("spt_count"),
        F.sort_array(F.collect_list(of(F.col("m_depth")))).alias("spt_depths"),
        F.avg(of(F.col("m_depth"))).alias("spt_depth_mean"),
        F.max(of(gap)).alias("spt_max_depth_difference"),
        F.min(F.struct(gap.alias("gap"), F.col("measurement_no"), F.col("m_depth"))).alias("nearest"),
    )
    out = given.join(found, "sample_id", "left")
    outcome = (
        F.when(F.col("candidate_holes") == 0, "no_matching_hole").when(F.col("candidate_holes") > 1, "ambiguous_hole").when(F.col("bad_interval"), "invalid_sample_interval")
        .when(F.coalesce("spt_count", F.lit(0)) == 0, "no_spt_in_interval").when(F.col("has_interval"), "interval_mean").otherwise("exact_depth_mean")
    )
    return out.select("sample_id", "hole_id", "candidate_holes", outcome.alias("n_match_method"), "n_measured", F.coalesce("spt_count", F.lit(0)).alias("spt_count"), F.coalesce("spt_depths", F.array().cast("array<double>")).alias("spt_depths"), "spt_depth_mean", "spt_max_depth_difference", F.col("nearest.m_depth").alias("nearest_depth"), F.col("nearest.gap").alias("nearest_depth_difference"))
