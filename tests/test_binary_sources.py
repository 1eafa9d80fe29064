"""Polygon files, archives and workbooks that the tests write by the formats' own rules."""

from __future__ import annotations

import datetime
import struct
import zipfile

import pytest

from geoledger.sources import shapes, tables, workbook

SHAPES = [
    [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.6), (0.6, 1.0), (0.5, 0.5)]],
    [],
    [[(10.0, 10.0), (11.0, 12.5), (12.0, 10.0), (10.0, 10.0)]],
    [[(float(k), float(k % 7)) for k in range(40)]],
]
ROWS = [("砂質土", 12, 1.25, True, "20240229"), ("", None, None, None, ""), ("x" * 10, -3, -0.5, False, "bad"), ("last", 7, 2.0, None, "19991231")]
FIELDS = [("NAME", "C", 10, 0), ("COUNT", "N", 6, 0), ("VALUE", "N", 10, 3), ("FLAG", "L", 1, 0), ("DAY", "D", 8, 0), ("rings", "C", 3, 0)]


def write_shapes(stem, outlines=SHAPES, rows=ROWS, kind=5, encoding="cp932", deleted=()):
    body, index = b"", b""
    for k, rings in enumerate(outlines):
        points = [p for r in rings for p in r]
        content = struct.pack("<i", 0)
        if rings:
            starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
            xs, ys = zip(*points, strict=True)
            content = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
            content += b"\1" * (16 + 8 * len(points)) if kind != 5 else b""  # measures
        index += struct.pack(">2i", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    files = {".shp": head(100 + len(body)) + body, ".shx": head(100 + len(index)) + index, ".prj": b'PROJCS["plane"]'}
    text = lambda v, n: ("" if v is None else "TF"[not v] if isinstance(v, bool) else str(v)).encode(encoding)[:n].ljust(n)
    lines = b"".join((b"*" if k in deleted else b" ") + b"".join(text(v, f[2]) for v, f in zip([*r, "abc"], FIELDS, strict=True)) for k, r in enumerate(rows))
    columns = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([size, digits]) + b"\0" * 14 for n, t, size, digits in FIELDS)
    files[".dbf"] = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(columns), 1 + sum(f[2] for f in FIELDS)) + columns + b"\r" + lines
    for ending, content in files.items():
        stem.with_suffix(ending).write_bytes(content)
    return files


def expected(k):
    name, count, number, flag, day = ROWS[k]
    date = {"20240229": datetime.date(2024, 2, 29), "19991231": datetime.date(1999, 12, 31)}.get(day)
    return (k, [[(x, y) for x, y in r] for r in SHAPES[k]], 'PROJCS["plane"]', name or None, count, number, flag, date, "abc")


def rows_of(df):
    return [(r[0], [[tuple(p) for p in ring] for ring in r[1]], *r[2:]) for r in sorted(df.collect(), key=lambda r: r[0])]


@pytest.mark.parametrize(("kind", "split"), [(5, 1), (25, 200), (5, 1 << 20)])
def test_polygon_file_in_stretches(spark, tmp_path, kind, split):
    write_shapes(tmp_path / "soil.shp", kind=kind)
    df = shapes.polygon_file(spark, str(tmp_path / "soil.shp"), "cp932", split)
    assert df.columns == ["record", "rings", "crs", "NAME", "COUNT", "VALUE", "FLAG", "DAY", "attribute_rings"]
    assert rows_of(df) == [expected(k) for k in range(4)]
    assert (df.rdd.getNumPartitions() > 1) == (split < 1 << 20)
    layer = tables.polygon_tiles([df.withColumnRenamed("VALUE", "x")])
    assert layer.count() == 3 and "attribute_x" in layer.columns  # the empty shape is gone


def test_polygon_file_with_deleted_rows_and_without_rows(spark, tmp_path):
    write_shapes(tmp_path / "a.shp", deleted=(0, 2))
    assert rows_of(shapes.polygon_file(spark, str(tmp_path / "a.shp"), "cp932")) == [expected(1), expected(3)]
    write_shapes(tmp_path / "b.shp", outlines=[], rows=[])
    assert shapes.polygon_file(spark, str(tmp_path / "b.shp")).count() == 0
    write_shapes(tmp_path / "c.shp", rows=ROWS[:2])
    with pytest.raises(Exception, match="4 outlines, 2 rows"):
        shapes.polygon_file(spark, str(tmp_path / "c.shp")).count()
    write_shapes(tmp_path / "d.shp", kind=3)
    with pytest.raises(Exception, match="isn't a polygon"):
        shapes.polygon_file(spark, str(tmp_path / "d.shp")).collect()


def test_which_polygon_files_are_taken(spark, tmp_path):
    names = lambda: [p.rsplit("/", 1)[1] for p in shapes.polygon_layers(spark, str(tmp_path))]
    (tmp_path / "deep").mkdir()
    write_shapes(tmp_path / "deep" / "line.shp", kind=3)
    with pytest.raises(ValueError, match="no polygon file"):
        names()
    write_shapes(tmp_path / "deep" / "a_poly.shp")
    assert names() == ["a_poly.shp"]
    write_shapes(tmp_path / "b_POLY.shp", kind=15)
    assert sorted(names()) == ["a_poly.shp", "b_POLY.shp"]
    write_shapes(tmp_path / "other.shp")
    with pytest.raises(ValueError, match="several polygon files"):
        names()
    with pytest.raises(ValueError, match="no shape file"):
        (tmp_path / "none").mkdir()
        shapes.polygon_layers(spark, str(tmp_path / "none"))


def test_polygon_archive(spark, tmp_path):
    files = write_shapes(tmp_path / "soil.shp")
    for n in (1, 2):
        with zipfile.ZipFile(tmp_path / f"map{n}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("readme.txt", "x")
            for ending, content in files.items():
                archive.writestr(f"folder/soil{ending.upper() if n == 2 else ending}", content)
    df = shapes.polygon_archive(spark, str(tmp_path), "cp932")
    assert rows_of(df) == [expected(k) for k in range(4) for _ in range(2)]
    with zipfile.ZipFile(tmp_path / "map3.zip", "w") as archive:
        for stem in ("a", "b"):
            for ending, content in files.items():
                archive.writestr(f"{stem}{ending}", content)
    with pytest.raises(ValueError, match="several polygon files"):
        shapes.polygon_archive(spark, str(tmp_path))


def write_book(path, sheets, shared=()):
    """sheets: name to lines of cells; a cell is an XML fragment, or None."""
    column = lambda k: (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        book.writestr("xl/workbook.xml", f"<workbook {space} {link}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="rId{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for k, lines in enumerate(sheets.values()):
            rows = "".join(f'<row r="{n}">' + "".join(c.replace("<c", f'<c r="{column(i)}{n}"', 1) for i, c in enumerate(cells) if c) + "</row>" for n, cells in lines.items())
            book.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>")


def number(v):
    return f"<c><v>{v}</v></c>"


def inline(v):
    return f'<c t="inlineStr"><is><t>{v}</t></is></c>'


def test_workbook_of_22_sheets_as_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook.WorkbookReader, "ROWS", 2)
    shared = ["<t>code</t>", "<t>土</t><rPh><t>つち</t></rPh>", "<r><t>two </t></r><r><t>runs</t></r>", "<t> </t>"]
    s = lambda n: f'<c t="s"><v>{n}</v></c>'
    sheets = {}
    for k in range(22):
        head = [s(0), inline(" mean "), None, inline("property")]
        sheets[f"p{k}"] = {1: [inline("title")], 4: head, 5: [s(1), number(k + 0.5)], 6: [s(2), None, '<c t="b"><v>1</v></c>', '<c t="e"><v>#N/A</v></c>'], 8: [s(3)], 30: [number(f"{k}"), None, None, inline("end")]}
    write_book(tmp_path / "book.xlsx", sheets, shared)
    df = workbook.workbook_sheets(spark, str(tmp_path / "book.xlsx"))
    assert df.columns == ["property", "code", "mean", "column_3", "property_4"] and df.rdd.getNumPartitions() == 22
    want = [row for k in range(22) for row in ((f"p{k}", "土", str(k + 0.5), None, None), (f"p{k}", "two runs", None, "true", None), (f"p{k}", str(k), None, None, "end"))]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_workbooks_with_other_headers_are_refused(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", {"a": {4: [inline("x")]}, "b": {4: [inline("y")]}})
    write_book(tmp_path / "b.xlsx", {"a": {1: [inline("x")]}})
    for name in ("a", "b"):
        with pytest.raises(Exception, match="no header, or several"):
            workbook.workbook_sheets(spark, str(tmp_path / f"{name}.xlsx")).collect()
    write_book(tmp_path / "c.xlsx", {"a": {4: [inline("x")]}})
    assert workbook.workbook_sheets(spark, str(tmp_path / "c.xlsx")).count() == 0
