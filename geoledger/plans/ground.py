"""A deterministic ground view over the driver's tables: holes, blow counts, zones, samples, a terrain and a mask.

Places and heights are whole numbers computed from keys, so that any engine gets the same values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

XMIN, YMIN, STEP, COLS, ROWS = -45800.0, 105400.0, 10.0, 6481, 6581
DEM = (60, 80)  # rows and columns of the small terrain
DEM_STEP = 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("hole_id"), (XMIN + STEP * (key * 7919 % COLS)).alias("x"), (YMIN + STEP * (key * 6131 % ROWS)).alias("y"), (F.col("o_custkey") % 400).cast("double").alias("surface_z"))


HOLE = "hole AS (SELECT o_orderkey AS hole_id, CAST(-45800 + 10 * ((o_orderkey * 7919) % 6481) AS DOUBLE) AS x, CAST(105400 + 10 * ((o_orderkey * 6131) % 6581) AS DOUBLE) AS y, CAST(o_custkey % 400 AS DOUBLE) AS surface_z FROM orders)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hole_id"), F.row_number().over(order).alias("measurement_no"), (F.col("l_quantity") - 1).alias("depth"), (F.col("l_extendedprice") / 1000).alias("n_value"))


SPT = "spt AS (SELECT l_orderkey AS hole_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS measurement_no, l_quantity - 1 AS depth, l_extendedprice / 1000 AS n_value FROM lineitem)"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 overlapping rectangles: poly_id, code, rings."""
    n = F.col("n_nationkey")
    x0, y0 = XMIN + 13000.0 * (n % 5), YMIN + 13200.0 * F.floor(n / 5)
    x1, y1 = x0 + 14000.0, y0 + 14000.0
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("poly_id"), F.concat(F.lit("Z"), F.pmod(n, F.lit(4)).cast("string")).alias("code"), F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))).alias("rings"))


ZONE = "zone AS (SELECT CAST(n_nationkey AS BIGINT) AS poly_id, 'Z' || (n_nationkey % 4) AS code, -45800.0::DOUBLE + 13000 * (n_nationkey % 5) AS x0, 105400.0::DOUBLE + 13200 * (n_nationkey // 5) AS y0, -45800.0::DOUBLE + 13000 * (n_nationkey % 5) + 14000 AS x1, 105400.0::DOUBLE + 13200 * (n_nationkey // 5) + 14000 AS y1 FROM nation)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A laboratory sample of each hole, some a little off their hole, some without an interval."""
    h = holes(spark, sf_dir)
    off = F.when(F.col("hole_id") % 7 == 0, 5.0).otherwise(0.0)
    top = (F.col("hole_id") % 30).cast("double")
    bottom = F.when(F.col("hole_id") % 11 == 0, top - 1).otherwise(top + 4)
    given = F.col("hole_id") % 5 != 0
    return h.select(F.col("hole_id").alias("sample_id"), (F.col("x") + off).alias("x"), "y", (top + 2).alias("depth"), F.when(given, top).alias("depth_top"), F.when(given, bottom).alias("depth_bottom"))


SAMPLE = "sample AS (SELECT hole_id AS sample_id, x + CASE WHEN hole_id % 7 = 0 THEN 5.0 ELSE 0.0 END AS x, y, CAST(hole_id % 30 AS DOUBLE) + 2 AS depth, CASE WHEN hole_id % 5 <> 0 THEN CAST(hole_id % 30 AS DOUBLE) END AS depth_top, CASE WHEN hole_id % 5 <> 0 THEN CAST(hole_id % 30 AS DOUBLE) + CASE WHEN hole_id % 11 = 0 THEN -1 ELSE 4 END END AS depth_bottom FROM hole)"


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of a coarse grid: the highest hole of each cell, less 20; cells without a hole, and below zero, are missing."""
    cell = lambda c, low: F.floor((F.col(c) - low) / DEM_STEP)
    cells = holes(spark, sf_dir).groupBy(cell("y", YMIN).alias("row"), cell("x", XMIN).alias("col")).agg((F.max("surface_z") - 20).alias("value"))
    return cells.filter(F.col("row").between(0, DEM[0] - 1) & F.col("col").between(0, DEM[1] - 1))


DEM_SQL = "dem AS (SELECT CAST(floor((y - 105400) / 1000) AS BIGINT) AS row, CAST(floor((x + 45800) / 1000) AS BIGINT) AS col, max(surface_z) - 20 AS value FROM hole WHERE floor((y - 105400) / 1000) < 60 GROUP BY 1, 2)"


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle of each customer, coded by nation: many overlap."""
    k = F.col("c_custkey")
    x0, y0 = (XMIN + 10 * (k * 7919 % 6000)).cast("double"), (YMIN + 10 * (k * 6131 % 6000)).cast("double")
    x1, y1 = x0 + 500 + 100 * (k % 17), y0 + 500 + 100 * (k % 23)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return table(spark, sf_dir, "customer").select(k.cast("long").alias("poly_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"), F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))).alias("rings"))


PARCEL = "parcel AS (SELECT CAST(c_custkey AS BIGINT) AS poly_id, 'N' || c_nationkey AS code, -45800.0::DOUBLE + 10 * (c_custkey * 7919 % 6000) AS x0, 105400.0::DOUBLE + 10 * (c_custkey * 6131 % 6000) AS y0, -45800.0::DOUBLE + 10 * (c_custkey * 7919 % 6000) + 500 + 100 * (c_custkey % 17) AS x1, 105400.0::DOUBLE + 10 * (c_custkey * 6131 % 6000) + 500 + 100 * (c_custkey % 23) AS y1 FROM customer)"
