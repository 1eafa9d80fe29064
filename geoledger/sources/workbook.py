"""Workbooks (.xlsx): sheets are members of a zip container, each read by a task of its own as a stream of rows.

`workbook_sheets` is a data source whose partitions are the sheets. The driver reads the container's directory, the list of sheets and each sheet's
header; a task unpacks its sheet row by row, and of the shared texts those it needs. The path is one that all machines see.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TARGET = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _path(path: str) -> str:
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in path:
        raise ValueError("a workbook needs a path that all machines see as a file")
    return path


def sheet_members(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet, member of the container) in the workbook's order."""
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_TARGET)}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    member = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(e.get("name"), member(targets[e.get(_LINK)])) for e in sheets]


def column_number(reference: str) -> int:
    """From 0, of a cell's reference such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(element: ElementTree.Element) -> str:
    """The text of a shared or inline string: of all its runs, without readings above the line."""
    return "".join(t.text or "" for child in element for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else []))


def sheet_rows(book: zipfile.ZipFile, member: str, last: int | None = None) -> Iterator[tuple[int, dict[int, str | tuple[str, int]]]]:
    """(line, cells by column) of a sheet, one row in memory at a time; a shared text is its number yet. Stops after line `last`."""
    with book.open(member) as stream:
        line = 0
        for _, e in ElementTree.iterparse(stream):
            if e.tag != f"{_MAIN}row":
                continue
            line = int(e.get("r") or line + 1)
            if last is not None and line > last:
                return
            cells, at = {}, -1
            for c in e.iter(f"{_MAIN}c"):
                at = column_number(c.get("r")) if c.get("r") else at + 1
                kind, value = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    inline = c.find(f"{_MAIN}is")
                    cells[at] = _text(inline) if inline is not None else ""
                elif value is not None and value.text is not None and kind != "e":
                    cells[at] = ("shared", int(value.text)) if kind == "s" else {"0": "false", "1": "true"}.get(value.text, value.text) if kind == "b" else value.text
            yield line, cells
            e.clear()


def shared_texts(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """Some of the container's shared texts, by number."""
    found: dict[int, str] = {}
    if not wanted or "xl/sharedStrings.xml" not in book.namelist():
        return found
    with book.open("xl/sharedStrings.xml") as stream:
        n = 0
        for _, e in ElementTree.iterparse(stream):
            if e.tag == f"{_MAIN}si":
                if n in wanted:
                    found[n] = _text(e)
                n += 1
                e.clear()
    return found


def _numbers(rows: list[dict]) -> set[int]:
    return {v[1] for cells in rows for v in cells.values() if isinstance(v, tuple)}


def headers(path: str, line: int) -> dict[str, list[str]]:
    """The texts of a line of each sheet, without white space around them, up to the last that isn't blank."""
    with zipfile.ZipFile(path) as book:
        rows = {name: next((c for n, c in sheet_rows(book, member, line) if n == line), {}) for name, member in sheet_members(book)}
        texts = shared_texts(book, _numbers(list(rows.values())))
    value = lambda v: (texts.get(v[1], "") if isinstance(v, tuple) else v or "").strip()
    return {name: [value(cells.get(k)) for k in range(max(cells, default=-1) + 1)] for name, cells in rows.items()}


class Sheet(InputPartition):
    def __init__(self, name: str, member: str):
        self.name, self.member = name, member


class WorkbookReader(DataSourceReader):
    #: Rows whose shared texts are looked up in one pass over them.
    ROWS = 20_000

    def __init__(self, path: str, line: int, columns: int):
        self.path, self.line, self.columns = path, line, columns

    def partitions(self) -> Sequence[InputPartition]:
        with zipfile.ZipFile(self.path) as book:
            return [Sheet(*s) for s in sheet_members(book)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as book:
            held: list[dict] = []
            for line, cells in sheet_rows(book, partition.member):
                if line > self.line:
                    held.append(cells)
                if len(held) >= self.ROWS:
                    yield from self.finished(book, partition.name, held)
                    held = []
            yield from self.finished(book, partition.name, held)

    def finished(self, book: zipfile.ZipFile, name: str, rows: list[dict]) -> Iterator[tuple]:
        texts = shared_texts(book, _numbers(rows))
        for cells in rows:
            values = [texts.get(v[1]) if isinstance(v, tuple) else v for v in (cells.get(k) for k in range(self.columns))]
            values = [None if v is None or not v.strip() else v.strip() for v in values]
            if any(v is not None for v in values):
                yield (name, *values)


class WorkbookSource(DataSource):
    """spark.read.format("workbook_sheets").option("header_line", 4).load("….xlsx")"""

    @classmethod
    def name(cls) -> str:
        return "workbook_sheets"

    def _columns(self) -> list[str]:
        found = headers(_path(self.options["path"]), int(self.options.get("header_line", 1)))
        distinct = {tuple(h) for h in found.values()}
        if len(distinct) != 1 or not any(next(iter(distinct))):
            raise ValueError("the sheets have no header, or several")
        names: list[str] = []
        for k, name in enumerate(distinct.pop()):
            name = name or f"column_{k + 1}"
            while name.lower() in {"property", *(n.lower() for n in names)}:
                name = f"{name}_{k + 1}"
            names.append(name)
        return names

    def schema(self) -> str:
        return ", ".join(["property string", *("`{}` string".format(n.replace("`", "``")) for n in self._columns())])

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(_path(self.options["path"]), int(self.options.get("header_line", 1)), len(schema.fields) - 1)


def workbook_sheets(spark: SparkSession, path: str, header_line: int = 4) -> DataFrame:
    """property (the sheet's name), then the columns of all sheets as text, from a workbook whose header stands on a given line and is the same in each. What
    stands above it isn't data; rows without any value are left out; numbers are the text that the file holds; blank headers become column_<number>."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook_sheets").option("header_line", header_line).load(path)
