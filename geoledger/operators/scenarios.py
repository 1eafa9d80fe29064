"""Experiments on fixed splits: how blow counts are best used, and whether labels predicted by first-stage teachers help.

Learners are functions (training, tuning, target, numeric, categorical, weight, trees) -> (model with predict(df), tree count): `boosted` by default, whose trees end where
the tuning rows' error was least, or grow to `trees` where no tuning rows are given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..storage import written
from . import boosting, joins, ledger, splits, summaries

#: How blow counts enter: scenario to (column of training, of tuning, of evaluation, whether reliability joins the features, whether rows without a measured count teach too).
SCENARIOS = {
    "no_n": (None, None, None, False, False),
    "measured_n": ("n_measured", "n_measured", "n_measured", False, False),
    "measured_to_predicted_n": ("n_measured", "n_measured", "n_predicted", False, False),
    "predicted_n": ("n_predicted", "n_predicted", "n_predicted", False, False),
    "predicted_n_reliability": ("n_predicted", "n_predicted", "n_predicted", True, False),
    "measured_plus_supplemental": ("n_either", "n_predicted", "n_predicted", False, True),
    "no_n_with_supplemental": (None, None, None, False, True),
}
RELIABILITY = ("n_ensemble_std", "n_interval_width", "n_nearest_hole_distance", "n_nearby_hole_count", "n_nearest_hole_depth_gap", "n_depth_extrapolation")

Learner = Callable[..., tuple]


class InsufficientData(ValueError):
    """A split has too few rows or groups to compare anything on."""


def boosted(training: DataFrame, tuning: DataFrame | None, target: str, numeric: Sequence[str], categorical: Sequence[str], weight: str | None = None, trees: int = 100, **options) -> tuple[boosting.Booster, int]:
    """boosting.fit with early stopping on the tuning rows."""
    if tuning is None:
        model = boosting.fit(training, target, numeric, categorical, trees=trees, weight=weight, **options)
        return model, len(model.trees)
    columns = list(dict.fromkeys([target, *numeric, *categorical, *([weight] if weight else [])]))
    taught = training.select(*columns).withColumn("_tune", F.lit(False))
    tuned = tuning.withColumns({weight: F.lit(1.0)}) if weight else tuning
    model = boosting.fit(taught.unionByName(tuned.select(*columns).withColumn("_tune", F.lit(True))), target, numeric, categorical, trees=trees, weight=weight, validation="_tune", **options)
    return model, len(model.trees)


def blow_count_scenarios(train: DataFrame, tuning: DataFrame, test: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], key: str, group: str, scenarios: Sequence[str] = tuple(SCENARIOS), supplemental_weight: float = 0.5, learner: Learner = boosted) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row of counts and metrics for each scenario; predictions of all scenarios; one row on the estimates themselves).

    Frames hold key, group, features, target, n_measured (null or NaN where none was measured), n_predicted, n_lower, n_upper and, for predicted_n_reliability, RELIABILITY. All
    scenarios are evaluated on the same test rows, those with a measured count, and tuned on tuning rows with one; rows without teach only in supplemental scenarios, with
    their own weight. measured_to_predicted_n is measured_n's model, fitted once, given predicted counts. Rows without a finite target take no part."""
    if unknown := set(scenarios) - set(SCENARIOS):
        raise ValueError(f"unknown scenarios: {', '.join(sorted(unknown))}")
    has = lambda df: df.filter(is_finite(F.col(target)))
    counted = lambda df: df.withColumn("n_measured", F.when(is_finite(F.col("n_measured")), F.col("n_measured"))).withColumn("n_either", F.coalesce("n_measured", "n_predicted"))
    measured = lambda df: df.filter(F.col("n_measured").isNotNull())
    train, tuning, test = (written(counted(has(df)), "scenario-part") for df in (train, tuning, test))
    primary = [measured(df) for df in (train, tuning, test)]
    sizes = [df.count() for df in primary]
    groups = primary[0].select(group).distinct().limit(2).count()
    if min(sizes) < 2 or groups < 2:
        raise InsufficientData(f"rows with a measured count: {sizes}; groups in training: {groups}")
    rows, told, models = [], [], {}
    for name in scenarios:
        taught, tuned, asked, reliability, supplemental = SCENARIOS[name]
        features = [*numeric, *(["n_value"] if taught else []), *(RELIABILITY if reliability else [])]
        value = lambda df, column: df.withColumn("n_value", F.col(column).cast("double")) if column else df
        frame = value(train if supplemental else primary[0], taught)
        model_of = "measured_n" if name == "measured_to_predicted_n" else name
        if model_of not in models:
            weight = "_weight" if supplemental else None
            frame = frame.withColumn("_weight", F.when(F.col("n_measured").isNotNull(), 1.0).otherwise(supplemental_weight)) if supplemental else frame
            models[model_of] = learner(frame, value(primary[1], tuned), target, features, categorical, weight)
        model, trees = models[model_of]
        out = model.predict(value(primary[2], asked)).select(F.lit(name).alias("scenario"), key, F.col(target).alias("actual"), "prediction")
        told.append(written(out, f"scenario-{name}"))
        n, own = frame.agg(F.count("*"), F.count("n_measured")).first()
        rows.append((name, model_of, trees, n, own, n - own, sizes[1], sizes[2], ",".join(features)))
    predictions = reduce(DataFrame.unionByName, told)
    counts = train.sparkSession.createDataFrame(rows, "scenario string, model string, trees int, training_rows long, primary_rows long, supplemental_rows long, tuning_rows long, test_rows long, features string")
    metrics = summaries.regression_metrics(predictions, "actual", "prediction", ["scenario"])
    estimates = summaries.regression_metrics(primary[2], "n_measured", "n_predicted")
    inside = primary[2].agg(F.avg(F.col("n_measured").between(F.col("n_lower"), F.col("n_upper")).cast("double")).alias("interval_coverage"), F.avg(F.col("n_upper") - F.col("n_lower")).alias("mean_interval_width"))
    return counts.join(metrics, "scenario"), predictions, estimates.join(F.broadcast(inside))  # one row each


def route(candidates: DataFrame, teachers: dict[str, Sequence[str]]) -> DataFrame:
    """candidates with source_model: the first teacher all of whose features a row has; the last one takes the rest."""
    names = list(teachers)
    column = F.lit(names[-1])
    for name in reversed(names[:-1]):
        has = reduce(lambda a, b: a & b, [F.coalesce(is_finite(F.col(c)), F.lit(False)) for c in teachers[name]], F.lit(True))
        column = F.when(has, name).otherwise(column)
    return candidates.withColumn("source_model", column)


def taught_labels(train: DataFrame, candidates: DataFrame, target: str, teachers: dict[str, Sequence[str]], group: str, seed: str, inner: float = 0.2, learner: Learner = boosted) -> tuple[DataFrame, list[dict]]:
    """(candidates with labels and source_model; how each teacher was fitted). A teacher's tree count is tuned on a part of the training groups, then it is fitted again on all
    training rows that have its features. Labels that candidates come with are never read."""
    routed = route(candidates.drop(target), teachers)
    dealt = written(splits.group_split(train.drop("split"), group, seed, 0.0, inner), "teacher-split")
    parts, told = [], []
    for name, features in teachers.items():
        whole = reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in features], is_finite(F.col(target)))
        usable = dealt.filter(F.coalesce(whole, F.lit(False)))
        fitting, tuning = (usable.filter(F.col("split") == k) for k in ("train", "validation"))
        sizes = [fitting.count(), tuning.count()]
        if min(sizes) < 2:
            raise InsufficientData(f"teacher {name}: rows {sizes}")
        _, trees = learner(fitting, tuning, target, list(features), [], None)
        model, _ = learner(usable, None, target, list(features), [], None, trees=max(1, trees))
        parts.append(model.predict(routed.filter(F.col("source_model") == name), target))
        told.append({"teacher": name, "rows": sum(sizes), "tuning_rows": sizes[1], "trees": max(1, trees)})
    return reduce(DataFrame.unionByName, parts), told


def two_stages(measured: DataFrame, candidates: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], teachers: dict[str, Sequence[str]], key: str, group: str, seeds: Sequence[int], test: float = 0.2, validation: float = 0.2, learner: Learner = boosted) -> tuple[DataFrame, DataFrame, int]:
    """(a row for each seed and student, measured_only and augmented: counts, tree count, overlap, metrics on measured test rows; mean and deviation over seeds by student; the
    median tree count of the augmented students, for a final fit).

    For each seed measured rows are split by group; candidates of a held-out group, or exactly at a held-out place, leave; teachers see training rows alone and label the
    rest anew; both students have equal weights and are tuned and tested on measured rows. The job fails if a hole stands on both sides."""
    forbidden = {target, "label_source", "source_model"} & {*numeric, *categorical}
    if forbidden:
        raise ValueError(f"not features: {', '.join(sorted(forbidden))}")
    ledger.assert_unique(measured.select(key).unionByName(candidates.select(key)), [key], "measured rows and candidates")
    rows, told = [], []
    for seed in seeds:
        dealt = written(splits.group_split(measured, group, f"two-stages-{seed}", test, validation), "stage-split")
        part = {k: dealt.filter(F.col("split") == k) for k in ("train", "validation", "test")}
        heldout = dealt.filter("split <> 'train'")
        safe = joins.exclude_heldout(candidates, heldout, group)
        pseudo, _ = taught_labels(part["train"], safe, target, teachers, group, f"teacher-{seed}", learner=learner)
        pseudo = written(pseudo, "stage-labels")
        ledger.assert_none(pseudo, ~F.coalesce(is_finite(F.col(target)), F.lit(False)), "a label isn't finite")
        columns = list(dict.fromkeys([key, group, target, *numeric, *categorical]))
        augmented = part["train"].select(*columns).withColumn("label_source", F.lit("measured")).unionByName(pseudo.select(*columns).withColumn("label_source", F.lit("predicted")))
        augmented = written(augmented, "stage-training")
        overlap = augmented.select(group).distinct().join(heldout.select(group).distinct(), group, "left_semi").count()
        if overlap:
            raise ValueError(f"seed {seed}: {overlap} held-out groups in training")
        for student, learning in (("measured_only", augmented.filter("label_source = 'measured'")), ("augmented", augmented)):
            model, trees = learner(learning, part["validation"], target, list(numeric), list(categorical), None)
            told.append(written(model.predict(part["test"]).select(F.lit(seed).alias("seed"), F.lit(student).alias("student"), key, F.col(target).alias("actual"), "prediction"), "stage-predictions"))
            n, own = learning.agg(F.count("*"), F.count_if(F.col("label_source") == "measured")).first()
            rows.append((seed, student, trees, n, own, n - own, overlap))
    counts = measured.sparkSession.createDataFrame(rows, "seed long, student string, trees int, training_rows long, measured_rows long, predicted_rows long, overlap long")
    scores = counts.join(summaries.regression_metrics(reduce(DataFrame.unionByName, told), "actual", "prediction", ["seed", "student"]), ["seed", "student"])
    trees = sorted(r[2] for r in rows if r[1] == "augmented")
    return scores, summaries.mean_std(scores, ["student"], ["r2", "rmse", "mae"]), int(trees[len(trees) // 2] if len(trees) % 2 else (trees[len(trees) // 2 - 1] + trees[len(trees) // 2]) / 2)
