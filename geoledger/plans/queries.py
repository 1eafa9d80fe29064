"""A query for each operator over the ground view, with the same in SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import projection as P
from ..operators import boosting, chunk_cache, graph, grid, joins, ledger, matching, ml, overlay, raster, reshape, scoring, spatial, splits, summaries
from ..storage import written
from . import ground
from .ground import DEM_SQL, HOLE, PARCEL, SAMPLE, SPT, ZONE, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def clean(spark: SparkSession, d: str) -> DataFrame:
    """Valid measurements, capped, with their hole's place."""
    good, _ = ledger.split(ground.measurements(spark, d), reshape.measurement_rules())
    return joins.validated_join(good.withColumn("n_value", C.upper_cap(F.col("n_value"))), ground.holes(spark, d), ["hole_id"], "inner", flag=None)


CLEAN = "clean AS (SELECT s.hole_id, measurement_no, depth, least(n_value, 50.0) AS n_value, x, y, surface_z FROM spt s JOIN hole h ON s.hole_id = h.hole_id WHERE depth > 0 AND n_value >= 0)"


@query(f"WITH {HOLE}, {SPT}, {CLEAN}, z AS (SELECT *, least(sqrt(15 * n_value) + 15, 40) AS phi, floor((x + 45800) / 13000) AS zone FROM clean) SELECT CAST(zone AS BIGINT) AS zone, count(*) AS n, round(avg(n_value), 6) AS n_mean, round(stddev_samp(n_value), 6) AS n_std, round(avg(phi), 6) AS phi_mean FROM z GROUP BY zone")
def phi_by_zone(spark, d):
    rows = clean(spark, d).withColumns({"phi": C.phi_from_n(F.col("n_value")), "zone": F.floor((F.col("x") - ground.XMIN) / 13000)})
    return rows.groupBy("zone").agg(F.count("*").alias("n"), r6(F.avg("n_value")).alias("n_mean"), r6(F.stddev_samp("n_value")).alias("n_std"), r6(F.avg("phi")).alias("phi_mean"))


@query(f"WITH {HOLE}, {SPT}, {CLEAN} SELECT hole_id, measurement_no, depth, round(n_value, 6) AS n_value, surface_z - depth AS sample_elevation, min(surface_z - depth) OVER (PARTITION BY hole_id) AS lowest, surface_z - depth - min(surface_z - depth) OVER (PARTITION BY hole_id) AS above_lowest FROM clean")
def spt_clean_capped(spark, d):
    rows = clean(spark, d).withColumn("sample_elevation", F.col("surface_z") - F.col("depth")).withColumn("lowest", F.min("sample_elevation").over(Window.partitionBy("hole_id")))
    return rows.select("hole_id", "measurement_no", "depth", r6("n_value").alias("n_value"), "sample_elevation", "lowest", (F.col("sample_elevation") - F.col("lowest")).alias("above_lowest"))


@query(f"WITH {SPT}, c AS (SELECT count(*) AS a, count(*) FILTER (depth IS NULL AND n IS NULL) AS b, count(*) FILTER ((depth IS NULL) <> (n IS NULL)) AS c, count(*) FILTER (depth <= 0) AS d, count(*) FILTER (n < 0) AS e FROM (SELECT nullif(depth, 3) AS depth, CASE WHEN depth < 5 THEN NULL ELSE n_value - 20 END AS n FROM spt)) SELECT 'input_rows' AS metric, a AS value FROM c UNION ALL SELECT 'both_missing', b FROM c UNION ALL SELECT 'one_missing', c FROM c UNION ALL SELECT 'depth_not_positive', d FROM c UNION ALL SELECT 'negative_value', e FROM c")
def spt_reason_counts(spark, d):
    rows = ground.measurements(spark, d).select(F.nullif("depth", F.lit(3.0)).alias("depth"), F.when(F.col("depth") >= 5, F.col("n_value") - 20).alias("n_value"))
    return ledger.reason_counts(rows, reshape.measurement_rules())


@query(f"WITH {SPT}, m AS (SELECT max(measurement_no) AS most FROM spt), s AS (SELECT DISTINCT hole_id FROM spt) SELECT s.hole_id, CAST(i AS SMALLINT) AS measurement_no, depth, round(n_value, 6) AS n_value FROM s CROSS JOIN m CROSS JOIN range(1, 200) t(i) LEFT JOIN spt ON spt.hole_id = s.hole_id AND spt.measurement_no = i WHERE i <= most")
def wide_to_long(spark, d):
    m = ground.measurements(spark, d)
    numbers = range(1, (m.agg(F.max("measurement_no")).first()[0] or 1) + 1)  # one number
    wide = m.groupBy("hole_id").agg(*(F.max(F.when(F.col("measurement_no") == i, F.col(v))).alias(f"{v[0]}{i}") for i in numbers for v in ("depth", "n_value")))
    long = reshape.wide_to_long(wide, "hole_id", [(f"d{i}", f"n{i}") for i in numbers])
    return long.select("hole_id", "measurement_no", "depth", r6("n_value").alias("n_value"))


@query(f"WITH {SPT} SELECT hole_id, depth, round(n_value, 6) AS n_value FROM (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY depth, n_value DESC) AS r FROM spt WHERE depth > 0) WHERE r = 1")
def shallowest_measurement(spark, d):
    return grid.shallowest(ground.measurements(spark, d).filter("depth > 0"), ["hole_id"]).select("hole_id", "depth", r6("n_value").alias("n_value"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand, p_size, p_partkey IS NOT NULL AS matched FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON l_partkey = p_partkey")
def many_to_one_enrich(spark, d):
    part = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return joins.validated_join(table(spark, d, "lineitem"), part, ["l_partkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p_brand", "p_size", "matched")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_audit(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


@query(f"WITH {HOLE}, held AS (SELECT * FROM hole WHERE hole_id % 10 = 0) SELECT hole_id, x, y FROM hole h WHERE hole_id NOT IN (SELECT hole_id FROM held) AND NOT EXISTS (SELECT 1 FROM held e WHERE e.x = h.x AND e.y = h.y)")
def heldout_exclusion(spark, d):
    h = ground.holes(spark, d)
    return joins.exclude_heldout(h, h.filter("hole_id % 10 = 0"), "hole_id").select("hole_id", "x", "y")


@query(f"WITH {HOLE}, held AS (SELECT * FROM hole WHERE hole_id % 50 = 0) SELECT hole_id, x, y FROM hole h WHERE NOT EXISTS (SELECT 1 FROM held e WHERE sqrt((e.x - h.x) ** 2 + (e.y - h.y) ** 2) <= 400)")
def distance_exclusion(spark, d):
    h = ground.holes(spark, d)
    return joins.exclude_near(h, h.filter("hole_id % 50 = 0"), 400.0, "hole_id").select("hole_id", "x", "y")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return ground.holes(spark, d).select(F.col("hole_id").alias("point_id"), "x", "y")


INSIDE = "inside AS (SELECT hole_id AS point_id, poly_id, code FROM hole JOIN zone ON x > x0 AND x < x1 AND y > y0 AND y < y1)"


@query(f"WITH {HOLE}, {ZONE}, {INSIDE}, f AS (SELECT point_id, min(poly_id) AS poly_id, arg_min(code, poly_id) AS code FROM inside GROUP BY 1) SELECT hole_id AS point_id, poly_id, code, CASE WHEN poly_id IS NULL THEN 'unmatched' ELSE 'within' END AS match_method FROM hole LEFT JOIN f ON hole_id = point_id")
def zone_first_match(spark, d):
    return spatial.first_match(_points(spark, d), ground.zones(spark, d), 7000.0)


@query(f"WITH {HOLE}, {ZONE}, t AS (SELECT hole_id AS point_id, poly_id, code, NOT (x > x0 AND x < x1 AND y > y0 AND y < y1) AS edge FROM hole JOIN zone ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY edge, poly_id) AS r FROM t) WHERE r = 1) SELECT hole_id AS point_id, poly_id, code, CASE WHEN poly_id IS NULL THEN 'unmatched' WHEN edge THEN 'intersects' ELSE 'within' END AS match_method FROM hole LEFT JOIN f ON hole_id = point_id")
def zone_first_match_fallback(spark, d):
    return spatial.first_match(_points(spark, d), ground.zones(spark, d), 7000.0, fallback=True)


@query(f"WITH {HOLE}, {ZONE}, {INSIDE}, f AS (SELECT point_id, min(code) AS lo, max(code) AS hi FROM inside GROUP BY 1) SELECT hole_id AS point_id, CASE WHEN lo = hi THEN lo ELSE 'UNKNOWN' END AS code FROM hole LEFT JOIN f ON hole_id = point_id")
def zone_conflict_null(spark, d):
    return spatial.agreed_code(_points(spark, d), ground.zones(spark, d), 7000.0)


@query(f"""WITH {HOLE}, {SPT}, {SAMPLE}, m AS (SELECT s.hole_id, x, y, depth, n_value, measurement_no FROM spt s JOIN hole h ON s.hole_id = h.hole_id),
near AS (SELECT sample_id, count(*) AS n, min(hole_id) AS hole_id FROM sample a JOIN (SELECT DISTINCT hole_id, x, y FROM m) h ON h.x BETWEEN a.x - 0.01 AND a.x + 0.01 AND abs(a.y - h.y) <= 0.01 AND sqrt((a.x - h.x) ** 2 + (a.y - h.y) ** 2) <= 0.01 GROUP BY 1),
g AS (SELECT a.*, coalesce(n, 0) AS candidate_holes, CASE WHEN n = 1 THEN hole_id END AS hole_id, depth_top IS NOT NULL AND depth_bottom IS NOT NULL AS hi, coalesce(depth_bottom < depth_top, false) AS bad FROM sample a LEFT JOIN near USING (sample_id)),
p AS (SELECT sample_id, avg(n_value) FILTER (ok) AS n_measured, count(*) FILTER (ok) AS spt_count, max(abs(md - depth)) FILTER (ok) AS spt_max_depth_difference, arg_min(md, (abs(md - depth), measurement_no)) AS nearest_depth FROM (SELECT g.sample_id, g.depth, m.depth AS md, m.n_value, m.measurement_no, NOT bad AND CASE WHEN hi THEN m.depth BETWEEN depth_top - 1e-6 AND depth_bottom + 1e-6 ELSE abs(m.depth - g.depth) <= 1e-6 END AS ok FROM g JOIN m ON g.hole_id = m.hole_id) GROUP BY 1)
SELECT sample_id, hole_id, candidate_holes, CASE WHEN candidate_holes = 0 THEN 'no_matching_hole' WHEN candidate_holes > 1 THEN 'ambiguous_hole' WHEN bad THEN 'invalid_sample_interval' WHEN coalesce(spt_count, 0) = 0 THEN 'no_spt_in_interval' WHEN hi THEN 'interval_mean' ELSE 'exact_depth_mean' END AS n_match_method, round(n_measured, 6) AS n_measured, coalesce(spt_count, 0) AS spt_count, spt_max_depth_difference, nearest_depth FROM g LEFT JOIN p USING (sample_id)""")
def interval_match(spark, d):
    m = joins.validated_join(ground.measurements(spark, d), ground.holes(spark, d), ["hole_id"], "inner", flag=None)
    return matching.match_intervals(ground.samples(spark, d), m, 0.01, 1e-6).select("sample_id", "hole_id", "candidate_holes", "n_match_method", r6("n_measured").alias("n_measured"), "spt_count", "spt_max_depth_difference", "nearest_depth")


@query("WITH e AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t FROM events), m AS (SELECT floor(avg(t)) AS mid FROM e), w AS (SELECT user_id, value, t, abs(t - mid) AS gap FROM e, m WHERE abs(t - mid) <= 864000), b AS (SELECT *, min(gap) OVER (PARTITION BY user_id) AS least FROM w) SELECT user_id, round(avg(value), 6) AS value, round(avg(t), 3) AS position, count(*) AS samples FROM b WHERE gap - least <= 1e-9 GROUP BY user_id")
def nearest_event(spark, d):
    e = table(spark, d, "events").select("user_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    middle = e.agg(F.floor(F.avg("t"))).first()[0]  # one number
    found = joins.select_nearest(e, ["user_id"], F.col("t"), float(middle), 864000.0, "value")
    return found.select("user_id", r6("value").alias("value"), F.round("position", 3).alias("position"), "samples")


@query(f"WITH {HOLE}, j AS (SELECT p.hole_id, t.hole_id AS ref_id, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS dist FROM hole p JOIN hole t ON t.x BETWEEN p.x - 1500 AND p.x + 1500 AND abs(p.y - t.y) <= 1500 AND p.hole_id <> t.hole_id), b AS (SELECT hole_id, count(*) AS n, min(dist) AS d, arg_min(ref_id, (dist, ref_id)) AS ref_id FROM j WHERE dist <= 1500 GROUP BY 1) SELECT p.hole_id, ref_id AS nearest_ref_id, round(d, 6) AS nearest_distance, coalesce(n, 0) AS n_within FROM hole p LEFT JOIN b USING (hole_id)")
def knn_hole(spark, d):
    h = ground.holes(spark, d)
    refs = h.select(F.col("hole_id").alias("ref_id"), "x", "y")
    return joins.nearest_reference(h, refs, 1500.0, "hole_id", "ref_id", itself=False).withColumn("nearest_distance", r6("nearest_distance"))


@query("SELECT p_type, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS weighted_mean, count(*) AS n, sum(l_quantity) AS weight_sum, min(l_extendedprice) AS value_min, max(l_extendedprice) AS value_max FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY p_type")
def weighted_property(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = joins.validated_join(table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity"), part, ["l_partkey"], "inner", flag=None)
    return summaries.weighted_mean(rows, ["p_type"], "l_extendedprice", "l_quantity").withColumn("weighted_mean", r6("weighted_mean"))


THICK = "t AS (SELECT p_type, l_linenumber AS horizon, sum(l_quantity) AS thickness FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _thickness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_type", F.col("l_linenumber").alias("horizon")).agg(F.sum("l_quantity").alias("thickness"))


@query(f"WITH {THICK} SELECT p_type, horizon, thickness, sum(thickness) OVER (PARTITION BY p_type ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS running FROM t")
def cumulative_thickness(spark, d):
    return summaries.cumulative(_thickness(spark, d), ["p_type"], ["horizon"], "thickness")


@query(f"WITH {THICK} SELECT p_type, " + ", ".join(f"coalesce(sum(CASE WHEN horizon = {i} THEN thickness END), 0) AS h{i}" for i in range(1, 8)) + " FROM t GROUP BY p_type")
def thickness_pivot(spark, d):
    horizons = [r.l_linenumber for r in table(spark, d, "lineitem").select("l_linenumber").distinct().orderBy("l_linenumber").collect()]  # a row for each column of the result
    return _thickness(spark, d).groupBy("p_type").pivot("horizon", horizons).agg(F.sum("thickness")).select("p_type", *(F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"h{i}") for i in horizons))


@query("SELECT l_returnflag, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_std FROM lineitem GROUP BY 1")
def metric_mean_std(spark, d):
    out = summaries.mean_std(table(spark, d, "lineitem"), ["l_returnflag"], ["l_discount", "l_tax"])
    return out.select("l_returnflag", *(r6(c).alias(c) for c in out.columns[1:]))


@query("WITH m AS (SELECT l_linenumber AS seed, l_returnflag AS condition, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), j AS (SELECT m.condition, m.v - b.v AS delta FROM m JOIN m b ON m.seed = b.seed AND b.condition = 'N') SELECT condition, round(avg(delta), 4) AS mean_delta, count(*) FILTER (delta > 0) AS improved, count(*) AS n FROM j GROUP BY 1")
def baseline_improvements(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("seed"), F.col("l_returnflag").alias("condition")).agg(F.avg("l_extendedprice").alias("v"))
    return summaries.baseline_deltas(m, ["seed"], "condition", "N", "v").groupBy("condition").agg(F.round(F.avg("delta"), 4).alias("mean_delta"), F.count_if("improved").alias("improved"), F.count("*").alias("n"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS any_purchase, arg_min(event_type, event_id) AS first_type, count(*) AS n, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id")
def site_flags(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.min_by("event_type", "event_id").alias("first_type"), F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"))


@query("WITH s AS (SELECT unnest(['A', 'N', 'R', 'X']) AS l_returnflag) SELECT s.l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O, CAST(0 AS BIGINT) AS Q, count(*) FILTER (l_linestatus IN ('F', 'O')) AS total FROM s LEFT JOIN lineitem l USING (l_returnflag) GROUP BY 1")
def crosstab_zero_filled(spark, d):
    return summaries.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["A", "N", "R", "X"], ["F", "O", "Q"])


@query("SELECT l_returnflag, round(avg(l_extendedprice * (1 - l_discount)), 6) AS net, round(avg(l_extendedprice * (1 + l_tax)), 6) AS gross, round(avg(l_extendedprice * (1 + l_tax)) - avg(l_extendedprice * (1 - l_discount)), 6) AS difference FROM lineitem GROUP BY 1")
def model_difference(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.inline(F.array(F.struct(F.lit("net").alias("model"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")), F.struct(F.lit("gross").alias("model"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("v")))))
    out = rows.groupBy("l_returnflag").pivot("model", ["net", "gross"]).agg(F.avg("v"))
    return out.select("l_returnflag", r6("net").alias("net"), r6("gross").alias("gross"), r6(F.col("gross") - F.col("net")).alias("difference"))


@query("WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 20) AS BIGINT) + 1, 20) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, round(lo + (b - 1) * (hi - lo) / 20, 4) AS lower, round(lo + b * (hi - lo) / 20, 4) AS upper, coalesce(n, 0) AS n, CAST(0 AS BIGINT) AS n_excluded FROM range(1, 21) t(b) CROSS JOIN s LEFT JOIN c ON bin = b")
def target_histogram(spark, d):
    return summaries.histogram(table(spark, d, "lineitem"), "l_extendedprice").withColumns({"lower": F.round("lower", 4), "upper": F.round("upper", 4)})


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 5).alias("fold"), F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500.0 + 500).alias("predicted"))


PRED = "p AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS fold, l_extendedprice AS actual, l_quantity * 1500.0::DOUBLE + 500 AS predicted FROM lineitem)"
METRICS = "count(*) AS n, round(avg(abs(actual - predicted)), 4) AS mae, round(sqrt(avg((actual - predicted) ** 2)), 4) AS rmse, round(avg(predicted - actual), 4) AS bias, round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 6) AS r2"


def _rounded(m: DataFrame) -> DataFrame:
    return m.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "bias")} | {"r2": F.round("r2", 6)})


@query(f"WITH {PRED} SELECT {METRICS} FROM p")
def regression_metrics(spark, d):
    return _rounded(summaries.regression_metrics(_predicted(spark, d), "actual", "predicted"))


@query(f"WITH {PRED}, f AS (SELECT fold, {METRICS} FROM p GROUP BY fold) SELECT 'fold_' || fold AS scope, n, mae, rmse, bias, r2 FROM f UNION ALL SELECT 'pooled', {METRICS} FROM p")
def metrics_by_fold(spark, d):
    p = _predicted(spark, d)
    folds = summaries.regression_metrics(p, "actual", "predicted", ["fold"]).withColumn("scope", F.concat(F.lit("fold_"), F.col("fold").cast("string"))).drop("fold")
    return _rounded(folds.unionByName(summaries.regression_metrics(p, "actual", "predicted").withColumn("scope", F.lit("pooled")))).select("scope", "n", "mae", "rmse", "bias", "r2")


@query(f"WITH {PRED} SELECT l_orderkey, l_linenumber, fold, round(predicted - actual, 4) AS residual, round(actual - predicted, 4) AS observed_less_predicted FROM p")
def oof_table(spark, d):
    return _predicted(spark, d).select("l_orderkey", "l_linenumber", "fold", F.round(F.col("predicted") - F.col("actual"), 4).alias("residual"), F.round(F.col("actual") - F.col("predicted"), 4).alias("observed_less_predicted"))


@query("SELECT event_type, value AS quantile, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = CAST(ceil((n - 1) * 0.9::DOUBLE) AS BIGINT) + 1")
def quantile_higher(spark, d):
    return summaries.quantile_higher(table(spark, d, "events"), ["event_type"], "value", 0.9)


SEEDS = "e AS (SELECT hole_id, measurement_no, n_value AS measured, n_value * 0.9::DOUBLE AS s1, n_value * 1.0::DOUBLE AS s2, n_value * 1.2::DOUBLE AS s3 FROM spt), i AS (SELECT *, (s1 + s2 + s3) / 3 AS m, sqrt(((s1 - (s1 + s2 + s3) / 3) ** 2 + (s2 - (s1 + s2 + s3) / 3) ** 2 + (s3 - (s1 + s2 + s3) / 3) ** 2) / 2) AS deviation FROM e), k AS (SELECT *, greatest(0, least(50, m)) AS prediction, greatest(0, least(50, m - 4)) AS lower, greatest(0, least(50, m + 4)) AS upper FROM i)"


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    e = ground.measurements(spark, d).select("hole_id", "measurement_no", F.col("n_value").alias("measured"), *((F.col("n_value") * f).alias(f"s{i}") for i, f in enumerate((0.9, 1.0, 1.2), 1)))
    return summaries.ensemble(e, ["s1", "s2", "s3"], F.lit(4.0), 0.0, 50.0)


@query(f"WITH {SPT}, {SEEDS} SELECT hole_id, measurement_no, round(prediction, 6) AS prediction, round(deviation, 6) AS deviation, round(lower, 6) AS lower, round(upper, 6) AS upper FROM k")
def ensemble_interval(spark, d):
    return _ensemble(spark, d).select("hole_id", "measurement_no", *(r6(c).alias(c) for c in ("prediction", "deviation", "lower", "upper")))


@query(f"WITH {SPT}, {SEEDS} SELECT round(avg(CASE WHEN measured BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(upper - lower), 6) AS mean_width, count(*) AS n FROM k")
def interval_coverage(spark, d):
    return summaries.coverage(_ensemble(spark, d), "measured").withColumns({"coverage": r6("coverage"), "mean_width": r6("mean_width")})


CATS = "c AS (SELECT p_partkey % 5 AS fold, p_brand || '-' || (p_size % 23) AS cat, count(*) AS n FROM part GROUP BY 1, 2), u AS (SELECT *, count(*) OVER (PARTITION BY cat) AS folds FROM c)"


@query(f"WITH {CATS}, v AS (SELECT fold, string_agg(cat, ',' ORDER BY cat) AS unseen, CAST(sum(n) AS BIGINT) AS unseen_rows FROM u WHERE folds = 1 GROUP BY 1) SELECT f.fold, coalesce(unseen, '') AS unseen, coalesce(unseen_rows, 0) AS unseen_rows FROM (SELECT DISTINCT fold FROM c) f LEFT JOIN v USING (fold)")
def unseen_categories(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 5).alias("fold"), F.concat_ws("-", "p_brand", (F.col("p_size") % 23).cast("string")).alias("cat"))
    return summaries.unseen_categories(p, "fold", "cat")


@query("SELECT source, count(*) AS n, count(l.doc_id) AS available, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS fraction FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source")
def availability_by_source(spark, d):
    both = joins.validated_join(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id"), ["doc_id"])
    return summaries.availability(both, "source", F.col("matched")).withColumn("fraction", r6("fraction"))


def _ranked(seed: str, key: str = "hole_id", source: str = "hole") -> str:
    return f"k AS (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {source}))"


@query(f"WITH {HOLE}, {_ranked('s1')} SELECT hole_id, CASE WHEN rank < ceil(n * 0.2::DOUBLE) THEN 'test' WHEN rank < 2 * ceil(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM k")
def group_split(spark, d):
    return splits.group_split(ground.holes(spark, d).select("hole_id"), "hole_id", "s1")


@query(f"WITH {SPT}, {_ranked('s2', source='spt')} SELECT hole_id, measurement_no, CAST(rank % 5 AS INTEGER) AS fold FROM spt JOIN k USING (hole_id)")
def kfold_groups(spark, d):
    return splits.group_folds(ground.measurements(spark, d).select("hole_id", "measurement_no"), "hole_id", 5, "s2")


SITES = "site AS (SELECT o_custkey AS owner, hole_id, x, y, CAST(floor(x / 10000) AS BIGINT) || ':' || CAST(floor(y / 10000) AS BIGINT) AS block FROM hole JOIN orders ON hole_id = o_orderkey)"


@query(f"WITH RECURSIVE {HOLE}, {SITES}, e AS (SELECT DISTINCT a.block AS a, b.block AS b FROM site a JOIN site b USING (owner)), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), g AS (SELECT a AS block, min(b) AS spatial_group FROM reach GROUP BY 1), t AS (SELECT hole_id, owner, block, spatial_group FROM site JOIN g USING (block)), {_ranked('s3', 'spatial_group', 't')} SELECT hole_id, owner, block, spatial_group, CAST(rank % 3 AS INTEGER) AS fold FROM t JOIN k USING (spatial_group)")
def spatial_block_folds(spark, d):
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("hole_id"), F.col("o_custkey").alias("owner"))
    return splits.spatial_block_folds(ground.holes(spark, d).join(owners, "hole_id"), "owner", 10000.0, 3, "s3").select("hole_id", "owner", "block", "spatial_group", "fold")


@query(f"WITH RECURSIVE {HOLE}, e AS MATERIALIZED (SELECT a.hole_id AS a, b.hole_id AS b FROM hole a JOIN hole b ON b.x BETWEEN a.x - 600 AND a.x + 600 AND abs(a.y - b.y) <= 600 AND a.hole_id <> b.hole_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 600), c(node, part) USING KEY (node) AS (SELECT hole_id, hole_id FROM hole UNION SELECT e.b, min(c.part) FROM c JOIN e ON e.a = c.node JOIN recurring.c AS old ON old.node = e.b WHERE c.part < old.part GROUP BY e.b) SELECT node AS hole_id, part AS location FROM c")
def connected_components(spark, d):
    return graph.location_groups(ground.holes(spark, d), 600.0, "hole_id")


MESH = "q AS (SELECT hole_id, 122 + (hole_id * 7919 % 30000) / 1024.0::DOUBLE AS lon, 24 + (hole_id * 6131 % 20000) / 1024.0::DOUBLE AS lat FROM hole), q1 AS (SELECT *, floor(lat * 1.5) AS a1, floor(lon - 100) AS o1, (lat * 1.5 - floor(lat * 1.5)) * 8 AS fa, (lon - 100 - floor(lon - 100)) * 8 AS fo FROM q), q2 AS (SELECT *, least(floor(fa), 7) AS a2, least(floor(fo), 7) AS o2 FROM q1), q3 AS (SELECT *, (fa - a2) * 10 AS ga, (fo - o2) * 10 AS go FROM q2), q4 AS (SELECT *, least(floor(ga), 9) AS a3, least(floor(go), 9) AS o3 FROM q3), q5 AS (SELECT *, ga - a3 AS ha, go - o3 AS ho FROM q4)"


@query(f"WITH {HOLE}, {MESH} SELECT hole_id, lpad(CAST(a1 AS INT)::VARCHAR, 2, '0') || lpad(CAST(o1 AS INT)::VARCHAR, 2, '0') || CAST(a2 AS INT) || CAST(o2 AS INT) || CAST(a3 AS INT) || CAST(o3 AS INT) || (1 + CAST(ho >= 0.5 AS INT) + 2 * CAST(ha >= 0.5 AS INT)) || (1 + CAST(ho * 2 - floor(ho * 2) >= 0.5 AS INT) + 2 * CAST(ha * 2 - floor(ha * 2) >= 0.5 AS INT)) AS meshcode FROM q5")
def meshcode(spark, d):
    k = F.col("hole_id")
    return ground.holes(spark, d).select("hole_id", C.meshcode_250m(122 + (k * 7919 % 30000) / 1024.0, 24 + (k * 6131 % 20000) / 1024.0).alias("meshcode"))


CELLS = "c AS (SELECT hole_id, CAST(round_even((x + (hole_id % 3) * 5 + 45800) / 10, 0) AS BIGINT) AS col, CAST(round_even((y - 105400) / 10, 0) AS BIGINT) AS row, x + (hole_id % 3) * 5 AS px, y FROM hole), g AS (SELECT *, col BETWEEN 0 AND 6480 AND row BETWEEN 0 AND 6580 AS inside, abs(px - (-45800 + col * 10)) <= 1e-4 AND abs(y - (105400 + row * 10)) <= 1e-4 AS aligned FROM c)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    shifted = ground.holes(spark, d).withColumn("x", F.col("x") + (F.col("hole_id") % 3) * 5)
    return grid.grid_cells(shifted, (ground.ROWS, ground.COLS), ground.XMIN, ground.YMIN, ground.STEP)


@query(f"WITH {HOLE}, {CELLS} SELECT hole_id, row, col, inside, aligned FROM g")
def grid_index(spark, d):
    return _cells(spark, d).select("hole_id", "row", "col", "inside", "aligned")


@query(f"WITH {HOLE}, m AS (SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, max(CASE WHEN hole_id % 6 = 0 THEN 0 ELSE 1 END) AS value FROM (SELECT hole_id, (x + 45800) / 10 AS col, (y - 105400) / 10 AS row FROM hole) GROUP BY 1, 2), p AS (SELECT CAST((y - 105400) / 10 AS BIGINT) AS row, CAST((x + 45800) / 10 AS BIGINT) AS col, max(surface_z - 20) AS prediction FROM hole WHERE hole_id % 8 <> 3 GROUP BY 1, 2), b AS (SELECT coalesce(value, 0) <> 0 AS active, prediction AS p FROM (SELECT * FROM m WHERE value <> 0) FULL JOIN p USING (row, col)) SELECT count(*) FILTER (active) AS active_cells, count(*) FILTER (active AND p IS NOT NULL) AS predicted_cells, count(*) FILTER (active AND p IS NULL) AS missing_cells, count(*) FILTER (NOT active AND p IS NOT NULL) AS outside_cells, min(p) FILTER (active) AS least, max(p) FILTER (active) AS most, count(*) FILTER (active AND p < 0) AS under, count(*) FILTER (active AND p > 50) AS over, CASE WHEN count(*) FILTER (active) > 0 AND count(*) FILTER (active AND p IS NULL) = 0 THEN 'complete' ELSE 'partial' END AS status FROM b")
def grid_coverage(spark, d):
    h = grid.grid_cells(ground.holes(spark, d), (ground.ROWS, ground.COLS), ground.XMIN, ground.YMIN, ground.STEP)
    mask = h.groupBy("row", "col").agg(F.max(F.when(F.col("hole_id") % 6 == 0, 0).otherwise(1)).alias("value"))
    return grid.coverage(mask, h.filter("hole_id % 8 <> 3").groupBy("row", "col").agg(F.max(F.col("surface_z") - 20).alias("prediction")))


CORNER = "q AS (SELECT hole_id, p, (x + dx * 1000 + 45800) / 1000 AS fc, (y + dy * 1000 - 105400) / 1000 AS fr FROM hole, (VALUES ('c', 0, 0), ('w', -1, 0), ('e', 1, 0), ('s', 0, -1), ('n', 0, 1)) o(p, dx, dy)), w AS (SELECT *, fc BETWEEN 0 AND 79 AND fr BETWEEN 0 AND 59 AS ok, least(CAST(floor(fc) AS BIGINT), 78) AS c0, least(CAST(floor(fr) AS BIGINT), 58) AS r0 FROM q), v AS (SELECT hole_id, p, ok, CASE WHEN ok THEN greatest(coalesce(a.value, 0), 0) * (1 - (fc - c0)) * (1 - (fr - r0)) + greatest(coalesce(b.value, 0), 0) * (fc - c0) * (1 - (fr - r0)) + greatest(coalesce(c.value, 0), 0) * (1 - (fc - c0)) * (fr - r0) + greatest(coalesce(d.value, 0), 0) * (fc - c0) * (fr - r0) ELSE 0 END AS z, CASE WHEN ok THEN least(coalesce(a.value, -1), coalesce(b.value, -1), coalesce(c.value, -1), coalesce(d.value, -1)) < 0 ELSE true END AS bad FROM w LEFT JOIN dem a ON a.row = r0 AND a.col = c0 LEFT JOIN dem b ON b.row = r0 AND b.col = c0 + 1 LEFT JOIN dem c ON c.row = r0 + 1 AND c.col = c0 LEFT JOIN dem d ON d.row = r0 + 1 AND d.col = c0 + 1), t AS (SELECT hole_id, max(z) FILTER (p = 'c') AS c, max(z) FILTER (p = 'w') AS w, max(z) FILTER (p = 'e') AS e, max(z) FILTER (p = 's') AS s, max(z) FILTER (p = 'n') AS n, bool_or(p = 'c' AND ok) AS inside, bool_or(bad) AS bad FROM v GROUP BY 1)"


@query(f"WITH {HOLE}, {DEM_SQL}, {CORNER} SELECT hole_id AS point_id, CASE WHEN inside THEN round(c, 6) END AS surface_z, CASE WHEN inside THEN round(degrees(atan(sqrt(((e - w) / 2000) ** 2 + ((n - s) / 2000) ** 2))), 6) END AS slope, CASE WHEN inside THEN round((e - 2 * c + w) / 1e6 + (n - 2 * c + s) / 1e6, 12) END AS curvature, bad OR NOT inside AS dem_missing FROM t")
def terrain_bilinear(spark, d):
    out = grid.terrain_at(_points(spark, d), ground.terrain(spark, d), ground.DEM, ground.XMIN, ground.YMIN, ground.DEM_STEP)
    return out.select("point_id", r6("surface_z").alias("surface_z"), r6("slope").alias("slope"), F.round("curvature", 12).alias("curvature"), "dem_missing")


STENCIL = "g AS (SELECT r AS row, c AS col FROM range(60) x(r), range(80) y(c)), z AS (SELECT row, col, greatest(coalesce(value, 0), 0) AS z, coalesce(value, -1) < 0 AS bad FROM g LEFT JOIN dem USING (row, col)), t AS (SELECT c.row, c.col, c.z AS c, coalesce(e.z, 0) AS e, coalesce(w.z, 0) AS w, coalesce(n.z, 0) AS n, coalesce(s.z, 0) AS s, c.bad OR coalesce(e.bad, true) OR coalesce(w.bad, true) OR coalesce(n.bad, true) OR coalesce(s.bad, true) AS bad FROM z c LEFT JOIN z e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN z w ON w.row = c.row AND w.col = c.col - 1 LEFT JOIN z n ON n.row = c.row + 1 AND n.col = c.col LEFT JOIN z s ON s.row = c.row - 1 AND s.col = c.col)"


@query(f"WITH {HOLE}, {DEM_SQL}, {STENCIL} SELECT row, col, c AS surface_z, round(degrees(atan(sqrt(((e - w) / 2000) ** 2 + ((n - s) / 2000) ** 2))), 6) AS slope, round((e - 2 * c + w) / 1e6 + (n - 2 * c + s) / 1e6, 12) AS curvature, bad AS dem_missing FROM t WHERE EXISTS (SELECT 1 FROM dem WHERE dem.row BETWEEN t.row // 16 * 16 - 2 AND t.row // 16 * 16 + 17 AND dem.col BETWEEN t.col // 16 * 16 - 2 AND t.col // 16 * 16 + 17)")
def terrain_cells(spark, d):
    out = raster.terrain(raster.tiles_of_cells(ground.terrain(spark, d), ground.DEM, 16), ground.DEM, ground.DEM_STEP, 16)
    return out.withColumns({"slope": r6("slope"), "curvature": F.round("curvature", 12)})


@query(f"WITH {HOLE}, {DEM_SQL}, g AS (SELECT r AS row, c AS col FROM range(60) x(r), range(80) y(c)), a AS (SELECT row, col, CAST(coalesce(value > 60, false) AS INTEGER) AS v FROM g LEFT JOIN dem USING (row, col)), q AS (SELECT a.row, a.col, a.v + 2 * b.v + 4 * c.v + 8 * d.v AS code FROM a JOIN a b ON b.row = a.row AND b.col = a.col + 1 JOIN a c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN a d ON d.row = a.row + 1 AND d.col = a.col), piece(code, sr, sc, er, ec) AS (VALUES (1, 0, 0.5, 0.5, 0), (2, 0.5, 1, 0, 0.5), (3, 0.5, 1, 0.5, 0), (4, 1, 0.5, 0.5, 1), (5, 0, 0.5, 0.5, 0), (5, 1, 0.5, 0.5, 1), (6, 1, 0.5, 0, 0.5), (7, 1, 0.5, 0.5, 0), (8, 0.5, 0, 1, 0.5), (9, 0, 0.5, 1, 0.5), (10, 0.5, 1, 0, 0.5), (10, 0.5, 0, 1, 0.5), (11, 0.5, 1, 1, 0.5), (12, 0.5, 0, 0.5, 1), (13, 0, 0.5, 0.5, 1), (14, 0.5, 0, 0, 0.5)) SELECT CAST(row + sr AS DOUBLE) AS start_row, CAST(col + sc AS DOUBLE) AS start_col, CAST(row + er AS DOUBLE) AS end_row, CAST(col + ec AS DOUBLE) AS end_col FROM q JOIN piece USING (code)")
def boundary_segments(spark, d):
    return raster.boundary_segments(_mask_tiles(spark, d), ground.DEM, 16)


@query(None)
def boundary_lines(spark, d):
    return raster.boundary_lines(raster.boundary_segments(_mask_tiles(spark, d), ground.DEM, 16))


def _mask_tiles(spark: SparkSession, d: str) -> DataFrame:
    return raster.tiles_of_cells(ground.terrain(spark, d).select("row", "col", (F.col("value") > 60).cast("int").alias("value")), ground.DEM, 16)


@query(f"WITH {HOLE}, {DEM_SQL}, a AS (SELECT row, col, value > 60 AS active FROM dem) SELECT a.row, a.col, 'right' AS side, a.active FROM a JOIN a b ON b.row = a.row AND b.col = a.col + 1 WHERE a.active <> b.active UNION ALL SELECT a.row, a.col, 'up', a.active FROM a JOIN a b ON b.row = a.row + 1 AND b.col = a.col WHERE a.active <> b.active")
def mask_boundary_edges(spark, d):
    return grid.mask_edges(ground.terrain(spark, d).select("row", "col", (F.col("value") > 60).cast("int").alias("value")))


@query(f"WITH {SPT} SELECT hole_id, measurement_no, round(least(sqrt(15 * greatest(n_value, 0)) + 15, 40), 6) AS phi FROM spt")
def phi_conversion(spark, d):
    return ground.measurements(spark, d).select("hole_id", "measurement_no", r6(C.phi_from_n(F.col("n_value"))).alias("phi"))


DENS = "d AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 16.0::DOUBLE - 0.5 END AS wet, (p_size % 9) / 4.0::DOUBLE AS dry FROM part), e AS (SELECT p_partkey, CASE WHEN wet > 0 THEN wet * 9.80665::DOUBLE END AS w, CASE WHEN dry > 0 THEN dry * 9.80665::DOUBLE END AS y FROM d)"


@query(f"WITH {DENS} SELECT p_partkey, CASE WHEN NOT coalesce(y > w, false) THEN round(w, 6) END AS gamma_wet, CASE WHEN NOT coalesce(y > w, false) THEN round(y, 6) END AS gamma_dry FROM e")
def density_to_gamma(spark, d):
    s = F.col("p_size")
    wet, dry = C.unit_weights(F.when(s % 7 != 0, s / 16.0 - 0.5), (s % 9) / 4.0)
    return table(spark, d, "part").select("p_partkey", r6(wet).alias("gamma_wet"), r6(dry).alias("gamma_dry"))


LAB = "lab AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'B0523' WHEN 1 THEN ' b0524' WHEN 2 THEN '' ELSE 'B0521' END AS code, CASE WHEN p_partkey % 2 = 0 THEN 'CUb' ELSE 'UU' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_size - 5.0::DOUBLE END AS own, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS DOUBLE) - 5 + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END END AS standard, p_size % 13 - 1.0::DOUBLE AS depth_mid FROM part), j AS (SELECT *, coalesce(own, standard) AS target, upper(trim(code)) IN ('B0523', 'B0524') OR (trim(code) = '' AND kind IN ('CUb', 'CD')) AS ok FROM lab)"


@query(f"WITH {LAB} SELECT p_partkey, target, CASE WHEN NOT ok THEN 'not_CUb_or_CD' WHEN abs(own - standard) > 1e-6 THEN 'conflicting_effective_cohesion_fields' WHEN target IS NULL OR target < 0 THEN 'missing_or_invalid_effective_cohesion' WHEN depth_mid < 0 THEN 'invalid_depth' END AS exclusion_reason FROM j")
def effective_cohesion(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    lab = table(spark, d, "part").select("p_partkey", F.when(s % 4 == 0, "B0523").when(s % 4 == 1, " b0524").when(s % 4 == 2, "").otherwise("B0521").alias("test_condition_code"), F.when(k % 2 == 0, "CUb").otherwise("UU").alias("test_type"), F.when(k % 3 == 0, s - 5.0).alias("c_effective"), F.when(k % 4 < 2, s.cast("double") - 5 + F.when(k % 9 == 0, 1).otherwise(0)).alias("shear_strength_effective"), (s % 13 - 1.0).alias("depth_mid"))
    return reshape.effective_cohesion(lab).select("p_partkey", "target", "exclusion_reason")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def dedup_keep_first(spark, d):
    return ledger.keep_first(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text")), ["text"], ["doc_id"]).select("doc_id", "is_duplicate")


@query("WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id, a.doc_id IS NOT NULL AS in_left, b.doc_id IS NOT NULL AS in_right FROM a FULL JOIN b USING (doc_id)")
def code_crosswalk(spark, d):
    return joins.crosswalk(table(spark, d, "documents").filter("doc_id % 3 <> 0"), table(spark, d, "labels"), "doc_id")


TEXT = "t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' 1,' || event_id || '.5 kPa' WHEN 1 THEN 'n/a' WHEN 2 THEN props WHEN 3 THEN 'abc' WHEN 4 THEN '-2.5e1' ELSE '' END AS s FROM events), n AS (SELECT event_id, replace(trim(s), ',', '') AS c FROM t), x AS (SELECT *, regexp_extract(c, '[-+]?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?', 0) AS f FROM n)"


@query(f"WITH {TEXT} SELECT event_id, CASE WHEN c <> '' AND lower(c) NOT IN ('nan', 'na', 'n/a', '-', '欠測', '未測定') AND f <> '' THEN CAST(f AS DOUBLE) END AS number FROM x")
def safe_number(spark, d):
    k = F.col("event_id")
    s = F.when(k % 6 == 0, F.concat(F.lit(" 1,"), k.cast("string"), F.lit(".5 kPa"))).when(k % 6 == 1, "n/a").when(k % 6 == 2, F.col("props")).when(k % 6 == 3, "abc").when(k % 6 == 4, "-2.5e1").otherwise("")
    return table(spark, d, "events").select("event_id", C.safe_number(s).alias("number"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 AND c_custkey % 180 > 0 THEN -1 ELSE 1 END * (c_custkey % 180 + (c_custkey % 60) / 60.0::DOUBLE + 30.25::DOUBLE / 3600) ELSE (c_custkey % 180) + 0.125::DOUBLE END, 9) AS degrees FROM customer")
def dms_degrees(spark, d):
    k = F.col("c_custkey")
    dms = F.concat(F.when(k % 4 == 0, "-").otherwise(""), (k % 180).cast("string"), F.lit("度"), (k % 60).cast("string"), F.lit("分30.25秒"))
    text = F.when(k % 2 == 0, dms).otherwise(F.concat((k % 180).cast("string"), F.lit(".125")))
    return table(spark, d, "customer").select("c_custkey", F.round(C.decimal_degrees(text), 9).alias("degrees"))


KINDS = ("B0522", "三軸 (UU) 試験", "CU-b 三軸", "圧密 非排水", "圧密排水試験", "Unconfined test", "direct shear", "")
EXPECTED = ("CU", "UU", "CUb", "CU", "CD", "一軸圧縮試験", "direct shear", "unknown")


@query("SELECT s_suppkey, CASE s_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(EXPECTED)) + " END AS test_type FROM supplier")
def test_type_map(spark, d):
    text = F.get(F.array(*(F.lit(x) for x in KINDS)), (F.col("s_suppkey") % 8).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", C.test_type(text).alias("test_type"))


@query("SELECT l_orderkey, '[' || string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ',' ORDER BY l_quantity) || ']' AS quantities FROM lineitem GROUP BY 1")
def json_list_cell(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list(F.col("l_quantity").cast("int")))).alias("quantities"))


@query("WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 END AS price FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(n.k, o.k) AS k, coalesce(n.price, o.price) AS price, status FROM o FULL JOIN n ON o.k = n.k")
def keyed_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    new = o.filter("k % 3 = 0").select("k", F.when(F.col("k") % 4 == 0, F.col("price") * 2).alias("price"))
    return joins.upsert(o.filter("k % 2 = 0"), new, "k")


@query(None)
def linear_baseline_predict(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    fitted = ml.fit(rows, ["l_quantity", "l_discount"], ["l_returnflag"], ml.linear("l_extendedprice"))
    return ml.predict(rows, fitted, ["l_quantity", "l_discount"], ["l_returnflag"]).select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


@query(None)
def boosted_out_of_fold(spark, d):
    rows = clean(spark, d).select("hole_id", "measurement_no", "x", "y", "depth", "n_value", "surface_z")
    found = ml.out_of_fold(rows, "n_value", ["x", "y", "depth", "surface_z"], [], "hole_id", 3, "cv", ml.boosted("n_value", trees=5, depth=3))
    return _rounded(summaries.regression_metrics(found, "n_value", "prediction", ["fold"]))


@query("SELECT p_brand AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 9) AS fraction FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def value_counts(spark, d):
    return summaries.value_counts(table(spark, d, "part"), "p_brand", top=20).withColumn("fraction", F.round("fraction", 9))


@query("WITH v AS (SELECT 'l_quantity' AS name, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) SELECT name, count(v) AS n, count(*) FILTER (v IS NULL) AS missing, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS least, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS most FROM v GROUP BY 1")
def describe(spark, d):
    out = summaries.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "median", "q75")})


@query("SELECT source, count(n_chars) AS count, CAST(min(n_chars) AS BIGINT) AS least, CAST(max(n_chars) AS BIGINT) AS most, round(avg(n_chars), 4) AS mean, median(n_chars)::DOUBLE AS median, CASE WHEN count(n_chars) = 0 THEN 'no_data' WHEN count(n_chars) < 50 THEN 'insufficient' ELSE 'ok' END AS status FROM documents GROUP BY 1")
def distribution_summary(spark, d):
    return summaries.distribution(table(spark, d, "documents"), ["source"], "n_chars", enough=50).withColumn("mean", F.round("mean", 4))


@query(f"WITH {PRED}, f AS (SELECT fold, count(*)::DOUBLE AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(predicted - actual) AS bias, 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2 FROM p GROUP BY fold), u AS (SELECT 'fold_' || fold AS population, n, mae, rmse, bias, r2 FROM f UNION ALL SELECT 'fold_mean', avg(n), avg(mae), avg(rmse), avg(bias), avg(r2) FROM f UNION ALL SELECT 'fold_std', stddev_samp(n), stddev_samp(mae), stddev_samp(rmse), stddev_samp(bias), stddev_samp(r2) FROM f UNION ALL SELECT s.l, count(*), avg(abs(actual - predicted)), sqrt(avg((actual - predicted) ** 2)), avg(predicted - actual), 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) FROM p, (VALUES ('pooled', 0.0), ('all_observed', 0.0)) s(l, z) GROUP BY 1) SELECT population, round(n, 3) AS n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(bias, 3) AS bias, round(r2, 6) AS r2 FROM u")
def metric_report(spark, d):
    p = _predicted(spark, d)
    out = summaries.metric_report(p, "actual", "predicted", "fold", observed=p)
    return out.select("population", *(F.round(c, 3).alias(c) for c in ("n", "mae", "rmse", "bias")), F.round("r2", 6).alias("r2"))


@query("SELECT o_orderpriority AS variant, CAST(floor(median(n)) AS INTEGER) AS median_trees, count(*) AS runs FROM (SELECT o_orderpriority, o_custkey % 7 AS seed, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def median_tree_count(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("variant"), F.col("o_custkey") % 7).agg(F.count("*").alias("trees"))
    return summaries.median_count(runs, ["variant"], "trees")


@query("WITH c AS (SELECT l_quantity AS sand, l_linenumber * 7.0 AS silt, CASE WHEN l_discount > 0.02 THEN 100 - l_quantity - l_linenumber * 7.0 + l_tax * 20 END AS clay FROM lineitem), s AS (SELECT sand + silt + clay AS s FROM c) SELECT count(*) AS rows, count(s) AS complete, round(min(s), 6) AS sum_least, round(avg(s), 6) AS sum_mean, round(max(s), 6) AS sum_most, count(*) FILTER (abs(s - 100) > 1.0000001) AS off_total FROM s")
def composition_sums(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 7.0
    grains = table(spark, d, "lineitem").select(q.alias("sand"), n.alias("silt"), F.when(F.col("l_discount") > 0.02, 100 - q - n + F.col("l_tax") * 20).alias("clay"))
    out = summaries.composition(grains, ["sand", "silt", "clay"], tolerance=1.0000001)
    return out.withColumns({c: r6(c) for c in ("sum_least", "sum_mean", "sum_most")})


@query(f"WITH {HOLE}, {ZONE}, {INSIDE}, f AS (SELECT point_id, arg_min(code, poly_id) AS code FROM inside GROUP BY 1), c AS (SELECT coalesce(code, 'UNKNOWN') AS code, count(*) AS cells, sum(surface_z) AS area FROM hole LEFT JOIN f ON hole_id = point_id GROUP BY 1) SELECT code, cells, round(cells / sum(cells) OVER ()::DOUBLE, 9) AS fraction, area, round(area / sum(area) OVER (), 9) AS area_fraction FROM c")
def code_fractions(spark, d):
    coded = spatial.first_match(_points(spark, d), ground.zones(spark, d), 7000.0).join(ground.holes(spark, d).select(F.col("hole_id").alias("point_id"), "surface_z"), "point_id")
    return summaries.code_fractions(coded, "code", F.col("surface_z")).withColumns({"fraction": F.round("fraction", 9), "area_fraction": F.round("area_fraction", 9)})


CLIPPED = "clipped AS (SELECT code, greatest(x0, -40000) AS x0, greatest(y0, 110000) AS y0, least(x1, 10000) AS x1, least(y1, 160000) AS y1 FROM parcel WHERE x0 < 10000 AND x1 > -40000 AND y0 < 160000 AND y1 > 110000)"


@query(f"WITH {PARCEL}, {CLIPPED}, xs AS (SELECT code, x, lead(x) OVER (PARTITION BY code ORDER BY x) AS x2 FROM (SELECT code, x0 AS x FROM clipped UNION SELECT code, x1 FROM clipped)), ys AS (SELECT code, y, lead(y) OVER (PARTITION BY code ORDER BY y) AS y2 FROM (SELECT code, y0 AS y FROM clipped UNION SELECT code, y1 FROM clipped)), a AS (SELECT code, sum((x2 - x) * (y2 - y)) AS area FROM xs JOIN ys USING (code) WHERE EXISTS (SELECT 1 FROM clipped p WHERE p.code = xs.code AND p.x0 <= x AND p.x1 >= x2 AND p.y0 <= y AND p.y1 >= y2) GROUP BY 1), k AS (SELECT DISTINCT code FROM parcel) SELECT code, round(coalesce(area, 0), 3) AS area FROM k LEFT JOIN a USING (code)")
def parcel_union_areas(spark, d):
    return overlay.union_areas(ground.parcels(spark, d), 1000.0, bounds=(-40000.0, 110000.0, 10000.0, 160000.0)).withColumn("area", F.round("area", 3))


@query(f"WITH {ZONE}, {PARCEL}, k AS (SELECT DISTINCT z.code AS za, p.code AS pb FROM zone z, parcel p), xs AS (SELECT za, pb, x, lead(x) OVER (PARTITION BY za, pb ORDER BY x) AS x2 FROM (SELECT za, pb, unnest([x0, x1]) AS x FROM k JOIN zone ON code = za UNION SELECT za, pb, unnest([x0, x1]) FROM k JOIN parcel ON code = pb)), ys AS (SELECT za, pb, y, lead(y) OVER (PARTITION BY za, pb ORDER BY y) AS y2 FROM (SELECT za, pb, unnest([y0, y1]) AS y FROM k JOIN zone ON code = za UNION SELECT za, pb, unnest([y0, y1]) FROM k JOIN parcel ON code = pb)) SELECT xs.za AS code_a, xs.pb AS code_b, round(sum((x2 - x) * (y2 - y)), 3) AS area FROM xs JOIN ys ON xs.za = ys.za AND xs.pb = ys.pb WHERE EXISTS (SELECT 1 FROM zone z WHERE z.code = xs.za AND z.x0 <= x AND z.x1 >= x2 AND z.y0 <= y AND z.y1 >= y2) AND EXISTS (SELECT 1 FROM parcel p WHERE p.code = xs.pb AND p.x0 <= x AND p.x1 >= x2 AND p.y0 <= y AND p.y1 >= y2) GROUP BY 1, 2")
def zone_parcel_overlay(spark, d):
    return overlay.overlay_areas(ground.zones(spark, d), ground.parcels(spark, d), 1000.0).withColumn("area", F.round("area", 3))


@query("SELECT DISTINCT c_nationkey AS code FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def common_codes(spark, d):
    return summaries.common_codes(table(spark, d, "customer").select(F.col("c_nationkey").alias("code")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("code")), "code")


@query("SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def colour_limits(spark, d):
    return summaries.colour_limits(table(spark, d, "lineitem"), "l_extendedprice")


LONLAT = "ll AS (SELECT hole_id, 118 + (hole_id * 7919 % 40000) / 1024.0::DOUBLE AS lon, 18 + (hole_id * 6131 % 30000) / 1024.0::DOUBLE AS lat FROM hole)"


def _lonlat(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("hole_id")
    return ground.holes(spark, d).select("hole_id", (118 + (k * 7919 % 40000) / 1024.0).alias("lon"), (18 + (k * 6131 % 30000) / 1024.0).alias("lat"))


@query(f"WITH {HOLE}, {LONLAT} SELECT hole_id, lon BETWEEN 122 AND 154 AND lat BETWEEN 20 AND 46 AS plausible FROM ll")
def plausible_coordinates(spark, d):
    return summaries.plausible(_lonlat(spark, d), "lon", "lat").select("hole_id", "plausible")


@query(f"WITH {HOLE}, {LONLAT}, b AS (SELECT CAST(floor(min(lat * 1.5)) AS INT) AS a0, CAST(floor(max(lat * 1.5)) AS INT) AS a1, CAST(floor(min(lon - 100)) AS INT) AS o0, CAST(floor(max(lon - 100)) AS INT) AS o1 FROM ll) SELECT lpad(a::VARCHAR, 2, '0') || lpad(o::VARCHAR, 2, '0') AS prefix FROM b, range(0, 100) x(a), range(0, 100) y(o) WHERE a BETWEEN a0 AND a1 AND o BETWEEN o0 AND o1")
def mesh_prefixes(spark, d):
    return summaries.mesh_prefixes(_lonlat(spark, d), "lon", "lat")


@query(f"WITH {HOLE} SELECT hole_id, x, y FROM hole WHERE CAST(x AS BIGINT) % 50 = 0 AND CAST(y AS BIGINT) % 50 = 0")
def regular_subsample(spark, d):
    return summaries.regular_subsample(ground.holes(spark, d), 50.0).select("hole_id", "x", "y")


@query("WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, (row_number() OVER (ORDER BY n DESC, md5(l_orderkey::VARCHAR), l_orderkey) - 1) % 10 AS t FROM g) SELECT l.l_orderkey, l_linenumber, CAST(CASE WHEN t < 5 THEN t ELSE 9 - t END AS INTEGER) AS fold FROM lineitem l JOIN r USING (l_orderkey)")
def balanced_folds(spark, d):
    return splits.balanced_folds(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 5)


TOPS = "tops AS (SELECT hole_id AS record_id, x + 37 AS x, y - 11 AS y, CAST(hole_id % 60 AS DOUBLE) AS depth FROM hole)"


@query(f"WITH {HOLE}, {SPT}, {TOPS}, j AS (SELECT record_id, t.depth, h.hole_id, sqrt((t.x - h.x) ** 2 + (t.y - h.y) ** 2) AS dist FROM tops t JOIN hole h ON h.x BETWEEN t.x - 400 AND t.x + 400 AND abs(t.y - h.y) <= 400), n AS (SELECT record_id, any_value(depth) AS depth, min(dist) AS dist, arg_min(hole_id, (dist, hole_id)) AS hole_id FROM j WHERE dist <= 400 GROUP BY 1) SELECT record_id, min(abs(spt.depth - n.depth)) AS n_nearest_hole_depth_gap FROM n JOIN spt USING (hole_id) GROUP BY 1")
def nearest_depth_gap(spark, d):
    h = ground.holes(spark, d)
    tops = h.select(F.col("hole_id").alias("record_id"), (F.col("x") + 37).alias("x"), (F.col("y") - 11).alias("y"), (F.col("hole_id") % 60).cast("double").alias("depth"))
    near = joins.nearest_at_all(tops, h, 400.0, "record_id", "hole_id")
    return joins.depth_gap(tops, near, ground.measurements(spark, d), "record_id", "hole_id")


GRID = "cell AS (SELECT row, col, min(hole_id) AS hole_id FROM (SELECT hole_id, CAST((x + 45800) / 10 AS BIGINT) AS col, CAST((y - 105400) / 10 AS BIGINT) AS row FROM hole) GROUP BY 1, 2), msk AS (SELECT row, col, CASE WHEN hole_id % 6 = 0 THEN 0 ELSE 1 END AS value FROM cell), pts AS (SELECT hole_id, x, y, surface_z FROM hole JOIN cell USING (hole_id) WHERE hole_id % 11 <> 4), sc AS (SELECT row, col, p.x, p.y, surface_z / 20 - 3 AS raw, surface_z / 25 AS dry FROM pts p JOIN cell USING (hole_id) JOIN msk USING (row, col) WHERE value <> 0), done AS (SELECT row, col, x, y, raw, greatest(0, least(15, raw)) AS wet, raw < 0 OR raw > 15 AS clipped_wet, greatest(0, least(15, dry)) AS dry, dry < 0 OR dry > 15 AS clipped_dry FROM sc)"


def _grid_job(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
    """Points of a grid, its mask, the scored cells, and the grid's place."""
    at = ((ground.ROWS, ground.COLS), ground.XMIN, ground.YMIN, ground.STEP)
    cells = grid.grid_cells(ground.holes(spark, d), *at)
    first = cells.groupBy("row", "col").agg(F.min_by(F.struct("hole_id", "x", "y", "surface_z"), "hole_id").alias("h")).select("row", "col", "h.*")
    mask = first.select("row", "col", F.when(F.col("hole_id") % 6 == 0, 0).otherwise(1).alias("value"))
    points = first.filter("hole_id % 11 <> 4").select("hole_id", "x", "y", "surface_z")  # a grid that misses some active cells
    predict = lambda p: p.withColumns({"wet": F.col("surface_z") / 20 - 3, "dry": F.col("surface_z") / 25})
    return points, mask, scoring.score(points, mask, *at, predict, ["wet", "dry"], 0.0, 15.0), at


@query(f"WITH {HOLE}, {GRID} SELECT row, col, x, y, round(wet, 6) AS wet, clipped_wet, round(dry, 6) AS dry, clipped_dry FROM done")
def grid_scores(spark, d):
    return _grid_job(spark, d)[2].withColumns({"wet": r6("wet"), "dry": r6("dry")})


@query(f"WITH {HOLE}, {GRID} SELECT (SELECT count(*) FROM msk WHERE value <> 0) AS active_cells, count(*) AS predicted_cells, (SELECT count(*) FROM msk WHERE value <> 0) - count(*) AS missing_cells, CAST(0 AS BIGINT) AS outside_rows, (SELECT count(*) FROM pts JOIN cell USING (hole_id) JOIN msk USING (row, col) WHERE value = 0) AS masked_rows, round(min(wet), 6) AS wet_least, round(max(wet), 6) AS wet_most, count(*) FILTER (clipped_wet) AS wet_clipped, round(min(dry), 6) AS dry_least, round(max(dry), 6) AS dry_most, count(*) FILTER (clipped_dry) AS dry_clipped, count(*) FILTER (dry > wet) AS dry_above_wet, 'incomplete' AS status FROM done")
def grid_report(spark, d):
    points, mask, scored, at = _grid_job(spark, d)
    return scoring.report(points, mask, scored, *at, ["wet", "dry"]).withColumns({f"{k}_{x}": r6(f"{k}_{x}") for k in ("wet", "dry") for x in ("least", "most")})


@query(f"WITH {HOLE}, {GRID} SELECT row % 10 AS band, count(*) AS n, round(avg(wet), 6) AS wet_mean, round(avg(dry), 6) AS dry_mean, round(avg(dry - wet), 6) AS difference_mean, round(avg(abs(dry - wet)), 6) AS difference_abs_mean, round(max(abs(dry - wet)), 6) AS difference_most FROM done GROUP BY 1")
def grid_difference(spark, d):
    out = scoring.difference(_grid_job(spark, d)[2].withColumn("band", F.col("row") % 10), "wet", "dry", ["band"])
    return out.select("band", "n", *(r6(c).alias(c) for c in out.columns[2:]))


@query(f"WITH {HOLE}, {GRID} SELECT row, col, round(wet, 6) AS wet FROM done WHERE row % 2 = 0 AND col % 2 = 0 AND (row, col) IN (SELECT (row, col) FROM cell WHERE hole_id % 3 <> 1)")
def display_cells(spark, d):
    shown = grid.grid_cells(ground.holes(spark, d), (ground.ROWS, ground.COLS), ground.XMIN, ground.YMIN, ground.STEP)
    shown = shown.groupBy("row", "col").agg(F.min("hole_id").alias("h")).select("row", "col", (F.col("h") % 3 != 1).cast("int").alias("value"))
    return scoring.display_cells(_grid_job(spark, d)[2], shown, 2).select("row", "col", r6("wet").alias("wet"))


@query(f"WITH {HOLE}, {SPT}, w AS (SELECT x, y, depth, n_value, abs(depth - 20) AS gap FROM spt JOIN hole USING (hole_id) WHERE abs(depth - 20) <= 5), b AS (SELECT *, min(gap) OVER (PARTITION BY x, y) AS least FROM w) SELECT x, y, round(avg(n_value), 6) AS value, count(*) AS samples, round(avg(depth), 6) AS observed_depth FROM b WHERE gap - least <= 1e-9 GROUP BY x, y")
def observed_overlay(spark, d):
    rows = ground.measurements(spark, d).join(ground.holes(spark, d), "hole_id").select("x", "y", "depth", F.col("n_value").alias("value"))
    return scoring.overlay(rows, 20.0, 5.0).withColumns({"value": r6("value"), "observed_depth": r6("observed_depth")})


@query(f"WITH {HOLE}, {DEM_SQL}, {CORNER}, {ZONE}, {INSIDE}, f AS (SELECT point_id, arg_min(code, poly_id) AS code FROM inside GROUP BY 1) SELECT h.hole_id AS point_id, CAST(h.hole_id % 30 AS DOUBLE) AS depth, CASE WHEN inside THEN round(c, 6) END AS surface_z, CASE WHEN inside THEN round(c - h.hole_id % 30, 6) END AS elevation, coalesce(f.code, 'UNKNOWN') AS zone FROM hole h JOIN t ON t.hole_id = h.hole_id LEFT JOIN f ON f.point_id = h.hole_id")
def enriched_points(spark, d):
    points = _points(spark, d).withColumn("depth", (F.col("point_id") % 30).cast("double"))
    out = scoring.enrich(points, ground.terrain(spark, d), ground.DEM, (ground.XMIN, ground.YMIN), ground.DEM_STEP, ground.zones(spark, d))
    return out.select("point_id", "depth", r6("surface_z").alias("surface_z"), r6("elevation").alias("elevation"), "zone")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 1.5::DOUBLE END AS number, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'soft clay' END AS text FROM customer")
def number_or_text(spark, d):
    k = F.col("c_custkey")
    said = F.when((k % 3 == 0) & (k % 2 == 0), "  soft clay ").when(k % 3 == 0, "未測定").otherwise(F.concat(F.lit("約 "), (k * 1.5).cast("string"), F.lit(" kPa")))
    n, text = C.number_or_text(said)
    return table(spark, d, "customer").select("c_custkey", n.alias("number"), text.alias("text"))


@query("SELECT page_id, regexp_replace(url, '[\\\\/:*?\"<>|]+', '_', 'g')[1:120] AS name FROM pages")
def safe_file_names(spark, d):
    return table(spark, d, "pages").select("page_id", C.file_name(F.col("url")).alias("name"))


def _training(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d).select(F.concat_ws("-", "hole_id", "measurement_no").alias("record_id"), F.col("hole_id").alias("boring_id"), "x", "y", "depth", "n_value", (F.col("surface_z") - F.col("depth")).alias("elevation"))


@query(None)
def n_estimate(spark, d):
    """Blow counts with reliability columns, for a place beside every hole. Trees aren't SQL."""
    rows = _training(spark, d)
    query_points = ground.holes(spark, d).select(F.col("hole_id").alias("record_id"), (F.col("x") + 35).alias("x"), F.col("y"), F.lit(12.0).alias("depth"), (F.col("surface_z") - 12).alias("elevation"))
    return ml.estimate_n(rows, query_points, ml.Estimator(("x", "y", "depth", "elevation"), seeds=(1, 2), trees=8))


@query(None)
def model_comparison(spark, d):
    """Metrics of models on shared folds, where one that fails is left out."""
    dealt = splits.group_folds(_training(spark, d), "boring_id", 2, "m16")
    models = {"linear": ml.fitted_with(ml.linear("n_value")), "trees": ml.fitted_with(ml.boosted("n_value", trees=5, depth=3)), "broken": lambda *_: 1 / 0}
    return ml.compare_models(dealt, "n_value", ["depth", "elevation"], [], models, "record_id", 2)[1]


@query(None)
def grouped_importance(spark, d):
    """Contribution of each configured feature in percent."""
    rows = written(_training(spark, d).withColumn("zone", F.floor((F.col("x") - ground.XMIN) / 13000).cast("string")), "importance-rows")
    numeric, categorical = ["depth", "elevation", "x"], ["zone"]
    fitted = ml.fit(rows, numeric, categorical, ml.boosted("n_value", trees=5, depth=3))
    return ml.importance(fitted, fitted.transform(ml.feature_frame(rows, numeric, categorical)), numeric, categorical, top=30)


def _series(terms: list[float], even: str, odd: str) -> tuple[str, str]:
    """(north, east) sums of the projection's series in SQL."""
    north = " + ".join(f"({a!r}) * sin({2 * j} * {even}) * cosh({2 * j} * {odd})" for j, a in enumerate(terms, 1))
    east = " + ".join(f"({a!r}) * cos({2 * j} * {even}) * sinh({2 * j} * {odd})" for j, a in enumerate(terms, 1))
    return north, east


_E = 2 * P._n() ** 0.5 / (1 + P._n())
_NORTH, _EAST = _series(P.forward_terms(), "xi", "eta")
PLANE = f"""ll AS (SELECT hole_id, 136 + (hole_id * 7919 % 20000) / 8192.0::DOUBLE AS lon, 35 + (hole_id * 6131 % 20000) / 8192.0::DOUBLE AS lat FROM hole),
s AS (SELECT *, sin(radians(lat)) AS s, radians(lon - {P.ZONE_7.lon!r}) AS d FROM ll), t AS (SELECT *, sinh(atanh(s) - {_E!r} * atanh({_E!r} * s)) AS t FROM s),
u AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)"""


@query(f"WITH {HOLE}, {PLANE} SELECT hole_id, round({P.radius(P.ZONE_7)!r} * (eta + {_EAST}), 3) AS x, round({P.radius(P.ZONE_7)!r} * (xi + {_NORTH}) - {P.arc(P.ZONE_7)!r}, 3) AS y, lon AS lon_back, lat AS lat_back FROM u")
def plane_coordinates(spark, d):
    """Degrees to metres, and back: the way back gives the degrees again."""
    k = F.col("hole_id")
    rows = ground.holes(spark, d).select("hole_id", (136 + (k * 7919 % 20000) / 8192.0).alias("longitude"), (35 + (k * 6131 % 20000) / 8192.0).alias("latitude"), F.lit("02").alias("datum_code"))
    placed, _ = P.project_records(rows)
    lon, lat = P.from_plane(F.col("x"), F.col("y"))
    return placed.select("hole_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.when(F.abs(lon - F.col("longitude")) < 1e-9, F.col("longitude")).alias("lon_back"), F.when(F.abs(lat - F.col("latitude")) < 1e-9, F.col("latitude")).alias("lat_back"))


@query(f"WITH {HOLE}, e AS (SELECT min(x) AS x0, min(y) AS y0 FROM hole), c AS (SELECT CAST(round((y - y0) / 10) AS BIGINT) AS row, CAST(round((x - x0) / 10) AS BIGINT) AS col, max(surface_z) AS value FROM hole, e GROUP BY ALL) SELECT row, col, value FROM c")
def display_raster(spark, d):
    return grid.display_raster(ground.holes(spark, d), 10.0, "surface_z")[0]


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS row_id FROM lineitem")
def dense_row_ids(spark, d):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return ledger.dense_ids(table(spark, d, "lineitem").select(columns), columns)


@query(None)
def missing_boosted_out_of_fold(spark, d):
    """Places are missing where the blow count is high: trees with a direction for missing values, holes held out."""
    rows = clean(spark, d).withColumn("x", F.when(F.col("n_value") < 40, F.col("x"))).select("hole_id", "measurement_no", "depth", "x", "y", "n_value")
    out = boosting.out_of_fold(rows, "n_value", ["depth", "x", "y"], [], "hole_id", 2, "gaps", trees=4, depth=3, rate=0.5, bins=32)
    return out.select("hole_id", "measurement_no", "fold", r6("prediction").alias("prediction"))


@query(None)
def chunk_digests(spark, d):
    """What a run compares with its manifest: a digest of each customer segment's orders."""
    o = table(spark, d, "orders").withColumn("chunk", F.pmod("o_custkey", F.lit(64)).cast("string"))
    return chunk_cache.chunk_digests(o, "chunk")
