"""Effective cohesion from start to end: held-out evaluation, a comparison of measured with estimated blow counts, a grid of predictions."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_range
from ..storage import written
from . import ledger, ml, scoring, splits, summaries
from .graph import location_groups

SCENARIOS = ("predicted_n", "measured_n")


@dataclasses.dataclass(frozen=True)
class Settings:
    """Features, and where n_value is one of them how blow counts are estimated (`estimator`, `folds` for rows that also teach)."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    estimator: ml.Estimator | None = None
    folds: int = 5
    least_holes: int = 5
    trees: int = 50
    seed: str = "cohesion"
    tolerance: float = 0.01

    @property
    def uses_n(self) -> bool:
        return "n_value" in self.numeric


def prepare(records: DataFrame, identity: Sequence[str], least_depth: float | None = None, most_depth: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may teach, records left out with exclusion_reason): the first of records repeated in `identity` (smallest record_id) with terrain
    under it and a depth inside the limits. records: record_id, depth, surface_z, identity."""
    first = records.groupBy(*identity).agg(F.min("record_id").alias("_first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in identity]
    told = records.alias("r").join(first.alias("f"), same).select("r.*", "_first")
    outside = ~F.coalesce(in_range(F.col("depth"), least_depth, most_depth), F.lit(False))
    reason = F.when(F.col("record_id") != F.col("_first"), "duplicate").when(F.col("surface_z").isNull(), "outside_dem").when(outside, "outside_training_depth_range")
    told = told.withColumn("exclusion_reason", reason).drop("_first")
    return told.filter("exclusion_reason IS NULL").drop("exclusion_reason").withColumn("sample_elevation", F.col("surface_z") - F.col("depth")), told.filter("exclusion_reason IS NOT NULL")


def located(data: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """data with boring_id as the smallest of the names that its place has (holes linked by steps within the tolerance are one), the own name in source_boring_id: so a place
    never stands in training and in the test under two names."""
    groups = location_groups(data.filter("x IS NOT NULL AND y IS NOT NULL"), tolerance).select(F.col("boring_id").alias("_own"), "location")
    own = data.withColumn("source_boring_id", F.col("boring_id")).join(groups, F.col("boring_id") == F.col("_own"), "left")
    return own.withColumn("boring_id", F.coalesce("location", "boring_id")).drop("_own", "location")


def _splittable(rows: DataFrame) -> bool:
    """Whether each split has two rows."""
    sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}  # three rows at most
    return min(sizes.get(s, 0) for s in ("train", "validation", "test")) >= 2


def _with_n(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    return rows.drop("n_value").join(estimates.select("record_id", F.col("n_predicted").alias("n_value")), "record_id")


def evaluate(rows: DataFrame, settings: Settings, scenario: str = "predicted_n", spt: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(predictions of the test rows, their metrics, the tree count). rows: record_id, boring_id, x, y, depth, target, split, features, and n_measured
    for measured_n. Estimated blow counts come from models that saw neither validation nor test places; predictions are never negative."""
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario must be one of {SCENARIOS}")
    if not _splittable(rows):
        raise ValueError("each split needs two rows")
    if settings.uses_n and scenario == "measured_n":
        rows = rows.withColumn("n_value", F.col("n_measured"))
    elif settings.uses_n:
        plain = rows.drop("n_value")
        told = ml.evaluation_n(plain.filter("split = 'train'"), plain.filter("split <> 'train'"), spt, settings.estimator, settings.folds)
        rows = written(_with_n(plain, told[0].select("record_id", "n_predicted").unionByName(told[1].select("record_id", "n_predicted"))), "cohesion-rows")
    taught = rows.filter("split <> 'test'").withColumn("_validation", F.col("split") == "validation")
    fitted, trees = ml.fit_early(taught, "target", settings.numeric, settings.categorical, "_validation", trees=settings.trees)
    told = ml.predict(rows.filter("split = 'test'"), fitted, settings.numeric, settings.categorical)
    told = written(told.withColumn("predicted_c", F.greatest("prediction", F.lit(0.0))).drop("prediction"), "cohesion-test")
    return told, summaries.regression_metrics(told, "target", "predicted_c"), trees


def compare(data: DataFrame, settings: Settings, spt: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(scenario, status, reason, n and the metrics; the tree count of predicted_n). Both scenarios meet the same split of the rows with a measured count,
    if those come from enough holes and each split has two of them; otherwise all rows are evaluated with estimates and measured_n is unavailable. Holes of one place are one."""
    data = written(located(data, settings.tolerance), "cohesion-located")
    common = data.filter("n_measured IS NOT NULL") if settings.uses_n else data
    holes = common.agg(F.count_distinct("boring_id")).first()[0] if settings.uses_n else 0
    both = settings.uses_n and holes >= settings.least_holes
    why = f"measured counts of {holes} holes; {settings.least_holes} are needed"
    if both:
        rows = written(splits.group_split(common, "boring_id", settings.seed), "cohesion-split")
        if not _splittable(rows):
            both, why = False, f"measured counts of {holes} holes leave a split with fewer than two rows"
    if not both:
        rows = written(splits.group_split(data, "boring_id", settings.seed), "cohesion-split")
    parts, trees = [], 0
    for scenario in SCENARIOS if both else SCENARIOS[:1]:
        _, metrics, n = evaluate(rows, settings, scenario, spt)
        trees = n if scenario == "predicted_n" else trees
        parts.append(metrics.withColumns({"scenario": F.lit(scenario), "status": F.lit("evaluated"), "reason": F.lit(None).cast("string")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if settings.uses_n and not both:
        gone = data.sparkSession.createDataFrame([("measured_n", "unavailable", why)], "scenario string, status string, reason string")
        out = out.unionByName(gone, allowMissingColumns=True)
    return out, trees


def final(data: DataFrame, settings: Settings, trees: int, spt: DataFrame | None = None) -> tuple[PipelineModel, DataFrame]:
    """(the model of all rows with the chosen tree count, its metrics on them). Blow counts are cross-fitted: none comes from a row's own place."""
    data = written(located(data, settings.tolerance), "cohesion-located")
    if settings.uses_n:
        plain = data.drop("n_value")
        data = written(_with_n(plain, ml.crossfit_n(plain, spt, settings.estimator, settings.folds)), "cohesion-final")
    fitted = ml.refit(data, "target", settings.numeric, settings.categorical, trees)
    told = ml.predict(data, fitted, settings.numeric, settings.categorical).withColumn("predicted_c", F.greatest("prediction", F.lit(0.0)))
    return fitted, ml.final_diagnostics(told, "target", "predicted_c")


def distribute(data: DataFrame, points: DataFrame, mask: DataFrame, shape: tuple[int, int], xmin: float, ymin: float, step: float, settings: Settings, spt: DataFrame | None = None, policy: str | None = None, path: str | None = None, chunk: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(comparison, metrics of the final fit, the grid's report). points: record_id, x, y, depth, features. The grid gets row, col, x, y, c, clipped_c, at `path`
    where one is given: as Parquet, or by `chunk` as gzip CSV under a policy of existing chunks."""
    comparison, trees = compare(data, settings, spt)
    fitted, diagnostics = final(data, settings, trees, spt)
    ledger.require_columns(points, ["record_id", "x", "y", "depth"])

    def predict(active: DataFrame) -> DataFrame:
        ready = _with_n(active, ml.estimate_n(spt, active.drop("n_value"), settings.estimator)) if settings.uses_n else active
        return ml.predict(ready, fitted, settings.numeric, settings.categorical).withColumnRenamed("prediction", "c")

    scored = written(scoring.score(points, mask, shape, xmin, ymin, step, predict, ["c"], least=0.0), "cohesion-grid")
    if path and chunk:
        places = points.select("x", "y", chunk)
        scoring.sinks.chunks(scored.join(places, ["x", "y"]), path, chunk, policy or "error")
    elif path:
        scored.write.parquet(path)
    return comparison, diagnostics, scoring.report(points, mask, scored, shape, xmin, ymin, step, ["c"])
