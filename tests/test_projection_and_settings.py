"""Plane coordinates against quadrature and the way back; checked settings; sinks and readers of odd formats."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from geoledger import settings
from geoledger.functions import projection as P
from geoledger.operators import grid, reshape
from geoledger.sources import sinks, tables


def arc_by_quadrature(a, b, n=20000):
    """Metres of meridian between two latitudes on GRS80."""
    f = 1 / P.GRS80[1]
    e2 = f * (2 - f)
    step = math.radians(b - a) / n
    return sum(P.GRS80[0] * (1 - e2) / (1 - e2 * math.sin(math.radians(a) + (i + 0.5) * step) ** 2) ** 1.5 * step for i in range(n))


def test_plane_on_the_central_meridian_and_back(spark):
    lats = [34.0, 35.5, 36.0, 36.7, 38.25]
    df = spark.createDataFrame([(P.ZONE_7.lon, v) for v in lats], "lon double, lat double")
    x, y = P.to_plane(F.col("lon"), F.col("lat"))
    for r in df.select("lat", x.alias("x"), y.alias("y")).collect():
        assert abs(r.x) < 1e-6
        assert abs(r.y - 0.9999 * arc_by_quadrature(36.0, r.lat)) < 1e-4
    grid_of = spark.range(400).select((135 + F.col("id") % 20 * 0.23).alias("lon"), (33 + F.floor(F.col("id") / 20) * 0.31).alias("lat"))
    placed = grid_of.select("lon", "lat", *(c.alias(n) for c, n in zip(P.to_plane(F.col("lon"), F.col("lat")), "xy", strict=True)))
    back = P.from_plane(F.col("x"), F.col("y"))
    worst = placed.agg(F.max(F.abs(back[0] - F.col("lon"))), F.max(F.abs(back[1] - F.col("lat")))).first()
    assert max(worst) < 1e-11


def test_plane_keeps_angles(spark):
    h = 1e-5
    df = spark.createDataFrame([(136.2, 35.1), (138.9, 37.4)], "lon double, lat double")
    at = lambda dx, dy: P.to_plane(F.col("lon") + dx, F.col("lat") + dy)
    (xe, ye), (xw, yw), (xn, yn), (xs, ys) = at(h, 0), at(-h, 0), at(0, h), at(0, -h)
    for r in df.select(*(c.alias(n) for c, n in zip((xe - xw, ye - yw, xn - xs, yn - ys), "abcd", strict=True))).collect():
        assert abs(r.a * r.c + r.b * r.d) / (math.hypot(r.a, r.b) * math.hypot(r.c, r.d)) < 1e-6


def test_records_by_datum(spark):
    rows = [("a", "137.2", "36.7", "02"), ("b", "137.2", "36.7", "00"), ("c", "137.2", "96", "01"), ("d", None, "36", "02"), ("e", "text", "36", "01")]
    placed, left = P.project_records(spark.createDataFrame(rows, "id string, longitude string, latitude string, datum_code string"))
    got = {r.id: r for r in placed.collect()}
    assert set(got) == {"a", "b"} and {(r.id, r.exclusion_reason) for r in left.collect()} == {(i, "invalid_coordinates") for i in "cde"}
    # the published linear form of the datum shift, good to some metres
    lon, lat = 137.2 - 0.000046038 * 36.7 - 0.000083043 * 137.2 + 0.010040, 36.7 - 0.00010695 * 36.7 + 0.000017464 * 137.2 + 0.0046017
    back = P.from_plane(F.lit(got["b"].x), F.lit(got["b"].y))
    r = spark.range(1).select(back[0].alias("lon"), back[1].alias("lat")).first()
    assert abs(r.lon - lon) < 5e-5 and abs(r.lat - lat) < 5e-5
    for bad in ("09", None):
        unknown = spark.createDataFrame([("a", "137", "36", bad)], "id string, longitude string, latitude string, datum_code string")
        with pytest.raises(Exception, match="datum code"):
            P.project_records(unknown)[0].collect()
    empty = spark.createDataFrame([], "longitude string, latitude string, datum_code string")
    assert [d.count() for d in P.project_records(empty)] == [0, 0]


def test_settings_are_checked():
    settings.Training(None, 20), settings.Validation("row", 0.1, 0.3, 7), settings.Scoring(5, 0.5, 0, 50, "archive")
    for wrong in (lambda: settings.Training(True), lambda: settings.Training(-1), lambda: settings.Training(3, 2), lambda: settings.Training(float("nan")), lambda: settings.Training(include_capped=1), lambda: settings.Validation("hole"), lambda: settings.Validation(test_size=1), lambda: settings.Validation(seed=True), lambda: settings.Scoring(None, 1), lambda: settings.Scoring(1, 1, 5, 4), lambda: settings.Scoring(1, 1, existing="keep")):
        with pytest.raises(ValueError):
            wrong()


def test_marked_csv_log_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("a", " 1", "2"), ("b", None, "4")], "key string, `深度1` string, `N値1` string")
    sinks.bom_csv(df, f"{tmp_path}/csv")
    files = [f for f in (tmp_path / "csv").glob("*.csv") if f.stat().st_size]
    assert files and all(f.read_bytes().startswith(b"\xef\xbb\xbfkey,") for f in files)
    assert sorted(map(tuple, tables.wide_csv(spark, f"{tmp_path}/csv", "key", 1).collect())) == [("a", " 1", "2"), ("b", None, "4")]
    with pytest.raises(ValueError):
        sinks.bom_csv(df.toDF("a,b", "c", "d"), f"{tmp_path}/never")
    for n in range(2):
        sinks.log(spark, f"{tmp_path}/log", "fit", {"rows": n})
    assert sorted(r.details["rows"] for r in spark.read.schema("details map<string,string>").json(f"{tmp_path}/log").collect()) == ["0", "1"]
    for n in (1, 2):
        sinks.summary(spark, f"{tmp_path}/summary", {"trees": n}, {"status": "complete"})
    assert [r.settings["trees"] for r in spark.read.schema("settings map<string,string>").json(f"{tmp_path}/summary").collect()] == ["2"]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("summary")] == ["summary"]
    for _ in range(2):
        df.write.parquet(sinks.dated(f"{tmp_path}/runs", datetime.date(2026, 1, 2)))
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 4  # both runs of the day
    assert {str(r.run_date) for r in spark.read.parquet(f"{tmp_path}/runs").collect()} == {"2026-01-02"}


def test_markdown(spark):
    df = spark.createDataFrame([("b|c", 1.5, 2), ("a", None, 1)], "name string, mean double, n int")
    assert sinks.markdown(df, ["name"], 2).splitlines() == ["| name | mean | n |", "| --- | --- | --- |", "| a |  | 1 |", "| b\\|c | 1.50 | 2 |"]
    with pytest.raises(ValueError):
        sinks.markdown(df, ["name"], most=1)


def test_display_raster(spark):
    points = spark.createDataFrame([(0.0, 0.0, 1.0), (20.0, 10.0, 2.0), (20.0, 10.0, 3.0)], "x double, y double, prediction double")
    cells, edge = grid.display_raster(points, 10.0)
    assert sorted(map(tuple, cells.collect())) == [(0, 0, 1.0), (1, 2, 3.0)]
    assert tuple(edge.first()) == (2, 3, -5.0, 25.0, -5.0, 15.0)
    cells, edge = grid.display_raster(points.limit(0), 10.0)
    assert cells.count() == 0 and tuple(edge.first()) == (None,) * 6


def test_lookup_in_a_national_encoding(spark, tmp_path):
    (tmp_path / "soil.csv").write_bytes("記号,土壌名\r\nA1, 黒ボク土\r\nB2,\"褐色,森林土\"\r\n\r\n".encode("cp932"))
    got = tables.lookup_csv(spark, f"{tmp_path}/soil.csv", "記号")
    assert sorted(map(tuple, got.collect())) == [("A1", "黒ボク土"), ("B2", "褐色,森林土")]
    (tmp_path / "twice.csv").write_bytes("記号,土壌名\nA1,x\nA1,y\n".encode("cp932"))
    with pytest.raises(ValueError):
        tables.lookup_csv(spark, f"{tmp_path}/twice.csv", "記号")


def test_property_sheets(spark, tmp_path):
    for name, value in (("湿潤密度", "1.8"), ("N+1 値", "12")):
        (tmp_path / f"{name}.csv").write_text(f"title\n\nnote\nid,value\n1,{value}\n\n2,\n", encoding="utf-8")
    got = tables.property_sheets(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [("N+1 値", "1", "12"), ("N+1 値", "2", None), ("湿潤密度", "1", "1.8"), ("湿潤密度", "2", None)]
    (tmp_path / "other.csv").write_text("a\nb\nc\nother,value\n", encoding="utf-8")
    with pytest.raises(ValueError):
        tables.property_sheets(spark, str(tmp_path))


def test_training_rows(spark):
    rows = [(1, 1.0, 10.0), (2, 5.0, 50.0), (3, 5.0, 80.0), (4, 20.0, 3.0), (5, None, 3.0), (6, 2.0, None), (7, 2.0, float("nan"))]
    df = spark.createDataFrame(rows, "id int, depth double, n_value double")
    kept, left = reshape.training_rows(df, settings.Training(1.0, 10.0))
    assert sorted((r.id, r.n_value) for r in kept.collect()) == [(1, 10.0), (2, 50.0), (3, 50.0)]
    assert {r.id: r.exclusion_reason for r in left.collect()} == {4: "outside_training_depth_range", 5: "outside_training_depth_range", 6: "missing_target", 7: "missing_target"}
    kept, left = reshape.training_rows(df, settings.Training(include_capped=False))
    assert sorted(r.id for r in kept.collect()) == [1, 4] and {r.id for r in left.filter("exclusion_reason = 'capped_target'").collect()} == {2, 3}
