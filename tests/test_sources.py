"""Readers, sinks and the resumable stream, by round trips through temporary folders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from geoledger.operators import reshape
from geoledger.sources import sinks, tables, xml_records
from geoledger.streaming import scoring

STRENGTH = """<?xml version="1.0" encoding="Shift_JIS"?>
<p:root xmlns:p="urn:x"><p:BoringId>B-001</p:BoringId><X>1,000</X><Y>2000</Y><孔口標高>10</孔口標高>
<Sample><試料番号>T-1</試料番号><開始深度>2</開始深度><終了深度>4</終了深度><土質名>砂</土質名>
<StrengthTest><試験名>UU三軸</試験名><粘着力全応力>20</粘着力全応力></StrengthTest></Sample></p:root>"""
DENSITY = "<root><緯度>35度30分36秒</緯度><経度>139.5</経度><試験情報><試料番号>1</試料番号><湿潤密度>1.8</湿潤密度></試験情報></root>"


def test_xml_records(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.xml").write_bytes(STRENGTH.encode("shift_jis"))
    (tmp_path / "B-7.XML").write_bytes(DENSITY.encode("utf-8-sig"))
    (tmp_path / "bad.xml").write_text("<root>")
    out = {r.file: r for r in xml_records.read_records(spark, str(tmp_path)).collect()}
    a, b = out["a.xml"], out["B-7.XML"]
    assert (a.boring_id, a.x, a.depth_mid, a.test_type, a.c_total, a.elevation) == ("B-001", 1000.0, 3.0, "UU", 20.0, 7.0)
    assert (b.boring_id, b.wet_density, b.latitude) == ("B-7", 1.8, pytest.approx(35.51)) and "ParseError" in out["bad.xml"].error
    summary = {r.metric: r.value for r in xml_records.presence_summary(xml_records.read_records(spark, str(tmp_path))).collect()}
    assert summary["strength_records"] == 2 and summary["present_c_total"] == 1


def test_strength_records_only(spark, tmp_path):
    """With `strength`, density tests are no records; fields under their other names are found."""
    (tmp_path / "d.xml").write_text(DENSITY, "utf-8")
    (tmp_path / "s.xml").write_text("<root><緯度_度>35</緯度_度><緯度_分>30</緯度_分><緯度_秒>36</緯度_秒><試験情報><湿潤密度>1.8</湿潤密度></試験情報><試験情報><せん断抵抗角_全応力>31</せん断抵抗角_全応力><D50>0.2</D50><液性限界>40</液性限界><試料標高>7.5</試料標高></試験情報><試験情報><試験名>CD</試験名></試験情報></root>", "utf-8")
    rows = xml_records.read_records(spark, str(tmp_path), strength=True).collect()
    assert {r.file for r in rows} == {"s.xml"} and len(rows) == 2
    found = next(r for r in rows if r.phi_total)
    assert (found.phi_total, found.d50, found.liquid_limit, found.elevation, found.latitude) == (31.0, 0.2, 40.0, 7.5, pytest.approx(35.51))
    assert len(xml_records.read_records(spark, str(tmp_path)).collect()) == 4


def test_matrix_of_several_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part-0.txt").write_text("1 2\n3 4\n")
    (tmp_path / "m" / "part-1.txt").write_text("\n5 6\n7 8\n")
    cells = {(r.row, r.col): r.value for r in tables.matrix_text(spark, str(tmp_path / "m"), (4, 2)).collect()}
    assert cells == {(i, j): 2.0 * i + j + 1 for i in range(4) for j in range(2)}


def test_files_tiles_and_imports(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("x")
    assert tables.exactly_one(spark, str(tmp_path), "a*.csv").endswith("a1.csv")
    with pytest.raises(ValueError, match="no file"):
        tables.exactly_one(spark, str(tmp_path), "b*.csv")
    (tmp_path / "a2.csv").write_text("y")
    with pytest.raises(ValueError, match="several"):
        tables.exactly_one(spark, str(tmp_path), "a*.csv")
    tile = lambda crs, n, extra="x": spark.createDataFrame([(crs, [[(0.0, 0.0)] * n], 1)], f"crs string, rings array<array<struct<x:double,y:double>>>, {extra} int")
    layer = tables.polygon_tiles([tile("6675", 3), tile("6675", 4, "code")])
    assert layer.count() == 2 and "attribute_x" in layer.columns
    for bad in ([tile("6675", 3), tile("4326", 3)], [tile("6675", 2)]):
        with pytest.raises(ValueError):
            tables.polygon_tiles(bad)
    known = spark.createDataFrame([("a1.csv", "0"), ("gone.csv", "1")], "name string, sha256 string")
    status = {r.name: r.status for r in tables.import_changes(known, tables.content_digests(spark, str(tmp_path))).collect()}
    assert status == {"a1.csv": "conflict", "a2.csv": "new", "gone.csv": "missing"}


def test_wide_csv(spark, tmp_path):
    pairs = [n for p in reshape.pair_names(2) for n in p]
    (tmp_path / "w.csv").write_text("ファイル名," + ",".join(pairs) + ",他\nh1,1,10,2,,z\nh2,1,x,2,5,z\n", "utf-8-sig")
    df = tables.wide_csv(spark, str(tmp_path / "w.csv"), "ファイル名", 2)
    long = reshape.wide_to_long(df, "ファイル名", reshape.pair_names(2)).collect()
    assert sorted((r["ファイル名"], r.measurement_no, r.n_value) for r in long if r.n_value) == [("h1", 1, 10.0), ("h2", 2, 5.0)]
    with pytest.raises(ValueError, match="missing columns"):
        tables.wide_csv(spark, str(tmp_path / "w.csv"), "ファイル名", 3)


def test_mesh_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("# comment\n 5339000001, 3, 250.5, 1.2, -, 1\n5440000001,1,1,1,1,1\n")
    df = tables.mesh_csv(spark, str(tmp_path / "m.csv"), prefixes=["5339"])
    assert [tuple(r) for r in df.collect()] == [("5339000001", 3.0, 250.5, 1.2, None, 1.0)]
    assert tables.mesh_csv(spark, str(tmp_path / "m.csv"), spark.createDataFrame([("5440000001",)], "code string")).count() == 1


def test_text_grids(spark, tmp_path):
    (tmp_path / "g.txt").write_text("  1 2 x y\n3  4 a b\n\n")
    assert sorted(map(tuple, tables.grid_text(spark, str(tmp_path / "g.txt")).collect())) == [(1.0, 2.0), (3.0, 4.0)]
    (tmp_path / "m.txt").write_text("\n".join(" ".join(str((r * 7 + c) % 5 - 2) for c in range(30)) for r in range(400)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = tables.matrix_text(spark, str(tmp_path / "m.txt"), (400, 30))
        assert out.filter(F.col("value") != F.pmod(F.col("row") * 7 + F.col("col"), F.lit(5)) - 2).count() == 0 and out.count() == 12000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="another shape"):
        tables.matrix_text(spark, str(tmp_path / "m.txt"), (399, 30))
    (tmp_path / "k.txt").write_text("0 -2 10\nnan 0 1\n")
    assert [r.value for r in tables.mask_text(spark, str(tmp_path / "k.txt")).orderBy("row", "col").collect()] == [0, 1, 1, 0, 0, 1]


def test_config_and_digests(spark, tmp_path):
    (tmp_path / "c.jsonc").write_text('// a comment\n{"a": [1, 2,],\n// more\n"b": "http://x",}\n')
    assert tables.read_config(spark, str(tmp_path / "c.jsonc")) == {"a": [1, 2], "b": "http://x"}
    (tmp_path / "l.tsv").write_text("symbol\tname\nA\tx\nA\ty\nB\tz\n")
    assert tables.legend(spark, str(tmp_path / "l.tsv")).count() == 2
    digests = tables.content_digests(spark, str(tmp_path / "l.tsv")).first()
    assert digests.size == 24 and len(digests.sha256) == 64


def test_chunk_policies(spark, tmp_path):
    df = spark.range(6).select("id", (F.col("id") % 2).cast("int").alias("chunk"))
    path = str(tmp_path / "out")
    sinks.chunks(df.filter("chunk = 0"), path, "chunk")
    with pytest.raises(Exception, match="already exists"):
        sinks.chunks(df, path, "chunk")
    sinks.chunks(df, path, "chunk", "resume")
    assert spark.read.option("header", "true").csv(path).count() == 6
    sinks.chunks(df, path, "chunk", "archive")
    assert len(list(tmp_path.iterdir())) == 2
    with pytest.raises(ValueError):
        sinks.chunks(df, path, "chunk", "other")


def test_matrix_sink(spark, tmp_path):
    mask = spark.range(9).select(F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).alias("col"), F.lit(1).alias("value"))
    sinks.matrix(mask, mask.withColumn("prediction", (F.col("row") * 3 + F.col("col")).cast("double")), (3, 3), str(tmp_path / "m"))
    lines = [x for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [" ".join(f"{3 * r + c:.6f}" for c in range(3)) for r in range(3)]


def test_scoring_resumes(spark, tmp_path):
    source, sink, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    spark.range(3).write.parquet(source)
    score = lambda: scoring.score_available(spark, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), sink, at)
    score()
    spark.range(3, 5).write.mode("append").parquet(source)
    score()
    assert sorted(r.twice for r in spark.read.parquet(sink).collect()) == [0, 2, 4, 6, 8]


def test_sample_numbers_and_conditions_are_fields(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<?xml version="1.0" encoding="Shift_JIS"?><r><試験情報><試料番号>T-1</試料番号><試料連番>007</試料連番><せん断試験条件>CUb</せん断試験条件><せん断試験条件コード>3</せん断試験条件コード><湿潤密度>1.9</湿潤密度></試験情報></r>'.encode("shift_jis"))
    r = xml_records.read_records(spark, str(tmp_path)).first()
    assert (r.sample_id, r.sample_no, r.test_condition, r.test_condition_code, r.wet_density) == ("T-1", "007", "CUb", "3", 1.9) and r.test_type
