"""Aggregations: weighted means, histograms, metrics, ensembles, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..storage import written


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Rows with a value and a positive weight count."""
    good = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    return good.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"), F.count("*").alias("n"), F.sum(weight).alias("weight_sum"), F.min(value).alias("value_min"), F.max(value).alias("value_max"))


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """running: sum of value up to each row, in a declared order."""
    return df.withColumn("running", F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def crosstab(df: DataFrame, row: str, column: str, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counts for every listed pair, zeros included, and the row's total."""
    counts = df.filter(F.col(row).isin(*rows)).groupBy(row).agg(*(F.count_if(F.col(column) == c).alias(c) for c in columns))
    spine = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} string")
    filled = spine.join(counts, row, "left").select(row, *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))
    return filled.withColumn("total", sum((F.col(c) for c in columns), F.lit(0)))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin (from 1), lower, upper, n: equal widths, the last bin closed, empty bins included; a constant input is widened by 0.5.
    Non-finite values are left out and counted in n_excluded."""
    good = is_finite(F.col(value))
    span = df.agg(F.min(F.when(good, F.col(value))).alias("lo"), F.max(F.when(good, F.col(value))).alias("hi"), F.count_if(~good).alias("n_excluded"))
    span = span.withColumns({"flat": F.col("lo") == F.col("hi")}).select(F.when(F.col("flat"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("flat"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "n_excluded")
    span = F.broadcast(span)  # one row
    place = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)).cast("int")
    counts = df.filter(good).join(span).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(span)
    width = (F.col("hi") - F.col("lo")) / bins
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"), (F.col("lo") + F.col("bin") * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "n_excluded")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, bias (predicted - actual), r2 (1 - SSE/SST; null where SST is 0) in one aggregation: variance carries SST."""
    a, p = F.col(actual), F.col(predicted)
    sums = df.filter(a.isNotNull() & p.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) ** 2)).alias("rmse"), F.avg(p - a).alias("bias"), F.sum((a - p) ** 2).alias("sse"), (F.var_pop(a) * F.count("*")).alias("sst"))
    return sums.withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))).drop("sse", "sst")


def mean_std(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))))


def baseline_deltas(df: DataFrame, keys: Sequence[str], condition: str, baseline: str, metric: str) -> DataFrame:
    """Per key and condition: the metric less the baseline condition's, and whether it is better (larger). df is computed once: sums of doubles that are made
    anew differ in their last digits, and the baseline would be better than itself."""
    df = written(df.select(*keys, condition, metric), "deltas")
    base = df.filter(F.col(condition) == baseline).select(*keys, F.col(metric).alias("_base"))
    return df.join(base, list(keys)).select(*keys, condition, (F.col(metric) - F.col("_base")).alias("delta"), (F.col(metric) > F.col("_base")).alias("improved"))


def quantile_higher(df: DataFrame, keys: Sequence[str], value: str, q: float, accuracy: int = 10_000) -> DataFrame:
    """quantile, n: the value at position ceil((n-1)q) of the sorted values. A sketch, whose rank is off by n / accuracy at most, brackets it; only
    distinct values inside the bracket are put in order, after counting those below, so no task sorts a whole group."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    at = [max(0.0, q - 4 / accuracy), min(1.0, q + 4 / accuracy)]
    span = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", at, accuracy).alias("_span"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    few = F.col("_n") <= accuracy  # all of them are the bracket
    low = F.when(few | F.lit(at[0] <= 0), F.col("_lo")).otherwise(F.get("_span", F.lit(0)))
    high = F.when(few | F.lit(at[1] >= 1), F.col("_hi")).otherwise(F.get("_span", F.lit(1)))
    span = span.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keys)), low.alias("_low"), high.alias("_high"), "_n", (F.ceil((F.col("_n") - 1) * q) + 1).alias("_rank"))
    both = rows.join(span, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)]) if keys else rows.join(F.broadcast(span))  # one row
    counted = both.filter("_v <= _high").groupBy(*keys, "_n", "_rank", F.greatest("_v", "_low").alias("_v")).agg(F.count("*").alias("_c"))  # all below count at the bracket's low end
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    return counted.withColumn("_upto", upto).filter("_upto >= _rank").groupBy(*keys, F.col("_n").alias("n")).agg(F.min("_v").alias("quantile")).select(*keys, "quantile", "n")


def ensemble(df: DataFrame, members: Sequence[str], radius: Column, least: float, most: float) -> DataFrame:
    """Mean and sample deviation across members (null for one member), and a symmetric interval clipped to limits."""
    mean = sum((F.col(m) for m in members), F.lit(0.0)) / len(members)
    var = sum(((F.col(m) - mean) ** 2 for m in members), F.lit(0.0)) / (len(members) - 1) if len(members) > 1 else F.lit(None).cast("double")
    clip = lambda c: F.greatest(F.lit(least), F.least(F.lit(most), c))
    out = df.withColumns({"prediction": clip(mean), "deviation": F.sqrt(var), "lower": clip(mean - radius), "upper": clip(mean + radius)})
    return out.withColumn("width", F.col("upper") - F.col("lower"))


def coverage(df: DataFrame, measured: str) -> DataFrame:
    inside = F.col(measured).between(F.col("lower"), F.col("upper"))
    return df.agg(F.avg(inside.cast("double")).alias("coverage"), F.avg("width").alias("mean_width"), F.count("*").alias("n"))


def unseen_categories(df: DataFrame, fold: str, category: str) -> DataFrame:
    """For each fold: its categories that no other fold has, and the rows that hold them. One row for each category and fold is
    all that is compared."""
    counts = df.groupBy(fold, category).agg(F.count("*").alias("n"))
    lone = counts.withColumn("folds", F.count("*").over(Window.partitionBy(category)))
    unseen = lone.filter("folds = 1").groupBy(fold).agg(F.array_join(F.array_sort(F.collect_set(category)), ",").alias("unseen"), F.sum("n").alias("unseen_rows"))
    return counts.select(fold).distinct().join(unseen, fold, "left").select(fold, F.coalesce("unseen", F.lit("")).alias("unseen"), F.coalesce("unseen_rows", F.lit(0)).alias("unseen_rows"))


def availability(df: DataFrame, by: str, present: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(present).alias("available"), F.avg(present.cast("double")).alias("fraction"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """value, n, fraction of each value, null too; top: only the most frequent, ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    out = counts.join(F.broadcast(df.agg(F.count("*").alias("_all")))).select("value", "n", (F.col("n") / F.col("_all")).alias("fraction"))  # one row
    return out.orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(top) if top else out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], few_keys: bool = False, accuracy: int = 10_000) -> DataFrame:
    """keys and an array `quantiles` of the exact quantiles of the finite values, between two values in proportion; keys without a finite value have no row.

    As in `quantile_higher` a sketch brackets each place in the order; what lies below a bracket is counted only, and distinct values inside it are put in order, so
    no task holds or sorts a group. few_keys: the keys are few by construction, so their brackets are broadcast."""
    rows = df.filter(is_finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("_v"))
    edges = [max(0.0, min(1.0, q + d)) for q in at for d in (-4 / accuracy, 4 / accuracy)]
    span = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    few = F.col("_n") <= accuracy  # all of them are the bracket

    def bracket(i: int, q: float) -> Column:
        low, high = F.get("_e", F.lit(2 * i)), F.get("_e", F.lit(2 * i + 1))
        place = (F.col("_n") - 1) * q
        low = F.when(few | F.lit(edges[2 * i] <= 0), F.col("_lo")).otherwise(low)
        high = F.when(few | F.lit(edges[2 * i + 1] >= 1), F.col("_hi")).otherwise(high)
        return F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"), (F.floor(place) + 1).alias("first"), (F.ceil(place) + 1).alias("second"), (place - F.floor(place)).alias("part"))

    span = span.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(keys)), F.array(*(bracket(i, q) for i, q in enumerate(at))).alias("_b"))
    same = [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(keys)]
    both = rows.join(F.broadcast(span) if few_keys or not keys else span, same or None)
    inside = F.filter("_b", lambda x: F.col("_v") <= x["high"])
    counted = both.select(*keys, "_v", F.explode(inside).alias("b")).groupBy(*keys, "b", F.greatest("_v", "b.low").alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "b.i").orderBy("_v"))
    of = lambda rank: F.min(F.when(F.col("_upto") >= F.col(f"b.{rank}"), F.col("_v")))
    # the value above the place may lie beyond the bracket only if the sketch is off by its bound: the bracket is eight times as wide
    found = counted.withColumn("_upto", upto).groupBy(*keys, "b").agg(of("first").alias("x"), of("second").alias("y"))
    value_at = F.when(F.col("b.part") == 0, F.col("x")).otherwise(F.col("x") * (1 - F.col("b.part")) + F.col("y") * F.col("b.part"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("b.i", value_at.alias("q")))), lambda s: s["q"]).alias("quantiles"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: count of finite values, missing, mean, std, min, quartiles (exact), max."""
    rows = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))))
    v = F.when(is_finite(F.col("v")), F.col("v"))
    out = rows.groupBy("name").agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
    quarters = exact_quantiles(rows, ["name"], "v", [0.25, 0.5, 0.75], few_keys=True)
    q = [F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))]
    return out.join(quarters, "name", "left").select("name", "n", "missing", "mean", "std", "least", *q, "most")


def distribution(df: DataFrame, keys: Sequence[str], value: str, enough: int = 5) -> DataFrame:
    """count, least, most, mean, median (exact) of a value by keys, and status: insufficient below `enough` values, no_data without any."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    out = df.groupBy(*keys).agg(F.count(v).alias("count"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))
    middle = exact_quantiles(df, keys, value, [0.5]).select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(keys)), F.get("quantiles", F.lit(0)).alias("median"))
    same = [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(keys)]
    out = out.join(middle, same, "left") if keys else out.join(F.broadcast(middle), how="left")  # one row
    status = F.when(F.col("count") == 0, "no_data").when(F.col("count") < enough, "insufficient").otherwise("ok")
    return out.select(*keys, "count", "least", "most", "mean", "median", status.alias("status"))


def composition(df: DataFrame, parts: Sequence[str], total: float = 100.0, tolerance: float = 1.0) -> DataFrame:
    """One row: rows that hold all parts, least, mean and most of their sums, and how many are off the total by more than the tolerance."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & is_finite(F.col(p))
    s = F.when(whole, sum((F.col(p) for p in parts), F.lit(0.0)))
    return df.agg(F.count("*").alias("rows"), F.count(s).alias("complete"), F.min(s).alias("sum_least"), F.avg(s).alias("sum_mean"), F.max(s).alias("sum_most"), F.count_if(F.abs(s - total) > tolerance).alias("off_total"))


def metric_report(df: DataFrame, actual: str, predicted: str, fold: str, observed: DataFrame | None = None) -> DataFrame:
    """population, and the metrics: a row for each fold, mean and sample deviation over folds, the pooled out-of-fold row, and (observed: final
    fits on all rows) the all_observed row, which tells the fit and not the skill. The populations are labelled aggregates of the same kind."""
    names = ["n", "mae", "rmse", "bias", "r2"]
    folds = regression_metrics(df, actual, predicted, [fold])
    rows = folds.select(F.concat(F.lit("fold_"), F.col(fold).cast("string")).alias("population"), *(F.col(c).cast("double").alias(c) for c in names))
    for label, f in (("fold_mean", F.avg), ("fold_std", F.stddev_samp)):
        rows = rows.unionByName(folds.agg(*(f(F.col(c).cast("double")).alias(c) for c in names)).withColumn("population", F.lit(label)))
    for label, frame in (("pooled", df), ("all_observed", observed)):
        if frame is not None:
            rows = rows.unionByName(regression_metrics(frame, actual, predicted).select(F.lit(label).alias("population"), *(F.col(c).cast("double").alias(c) for c in names)))
    return rows


def median_count(df: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """The median of counts, cut to a whole number: the tree count that a final fit uses."""
    return df.groupBy(*keys).agg(F.floor(F.median(count)).cast("int").alias(f"median_{count}"), F.count("*").alias("runs"))


def code_fractions(coded: DataFrame, code: str, area: Column | None = None) -> DataFrame:
    """code, cells and fraction of the points of a grid (and of an area, where one is given) by code; each point counts once, so overlapping
    polygons don't count twice. Null codes are UNKNOWN."""
    by = coded.groupBy(F.coalesce(F.col(code), F.lit("UNKNOWN")).alias("code")).agg(F.count("*").alias("cells"), *([F.sum(area).alias("area")] if area is not None else []))
    whole = by.agg(F.sum("cells").alias("_cells"), *([F.sum("area").alias("_area")] if area is not None else []))
    out = by.join(F.broadcast(whole))  # one row
    return out.select("code", "cells", (F.col("cells") / F.col("_cells")).alias("fraction"), *([F.col("area"), (F.col("area") / F.col("_area")).alias("area_fraction")] if area is not None else []))


def common_codes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The codes that both tables hold."""
    return a.select(column).filter(F.col(column).isNotNull()).intersect(b.select(column))


def colour_limits(df: DataFrame, value: str, padding: float = 0.5) -> DataFrame:
    """One row: limits of a value's colours; a constant range is widened on both sides."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    return span.select(F.when(flat, F.col("lo") - padding).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + padding).otherwise(F.col("hi")).alias("hi"))


def plausible(df: DataFrame, longitude: str, latitude: str, west: float = 122.0, east: float = 154.0, south: float = 20.0, north: float = 46.0) -> DataFrame:
    """df with plausible: whether both coordinates lie in the box; the others are kept for the audit."""
    inside = F.col(longitude).between(west, east) & F.col(latitude).between(south, north)
    return df.withColumn("plausible", F.coalesce(inside, F.lit(False)))


def regular_subsample(df: DataFrame, spacing: float, tolerance: float = 1e-6) -> DataFrame:
    """The rows of which x and y are both multiples of the spacing."""
    off = lambda c: F.abs(F.col(c) - spacing * F.rint(F.col(c) / spacing)) <= tolerance
    return df.filter(off("x") & off("y"))


def mesh_prefixes(df: DataFrame, longitude: str, latitude: str) -> DataFrame:
    """The four-digit mesh prefixes that cover the box around all points: one aggregate, then a range."""
    box = df.agg(*(F.floor(f(c)).cast("int").alias(n) for n, f, c in (("a0", F.min, F.col(latitude) * 1.5), ("a1", F.max, F.col(latitude) * 1.5), ("o0", F.min, F.col(longitude) - 100), ("o1", F.max, F.col(longitude) - 100))))
    cells = box.filter("a0 IS NOT NULL AND o0 IS NOT NULL").withColumn("a", F.explode(F.sequence("a0", "a1"))).withColumn("o", F.explode(F.sequence("o0", "o1")))
    return cells.select(F.concat(F.lpad(F.col("a").cast("string"), 2, "0"), F.lpad(F.col("o").cast("string"), 2, "0")).alias("prefix"))
