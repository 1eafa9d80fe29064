"""Polygon files: binary outlines (.shp), their offset index (.shx), attributes of fixed length (.dbf) and a reference system (.prj).

`polygon_file` is a data source whose partitions are stretches of records: the driver reads the headers and the ends of each stretch from the index, and a
task seeks to its own stretch of outlines and attributes. It needs a path that all machines see. `polygon_archive` reads the same files out of zip
archives, an archive a task, from any store that Spark reads; a packed member can't be entered in the middle.

Columns: record (from 0), rings (array of arrays of x and y; none for an empty shape), crs (the text of the .prj file, or null), then the attributes: text
without the blanks that fill it, whole numbers, numbers, booleans and dates; blank ones are null. A name that `record`, `rings` or `crs` has already, or that
stands twice, gets the prefix attribute_.
"""

from __future__ import annotations

import datetime
import io
import os
import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RINGS = "array<array<struct<x:double,y:double>>>"
#: Kinds of shapes that are polygons: plain, with measures, with heights. What follows the points of the latter isn't read.
POLYGONS = {5, 15, 25}
#: Bytes of outlines in a partition, and records of a batch.
SPLIT_BYTES, BATCH = 8 << 20, 1000


@dataclass
class Field:
    name: str
    kind: str
    start: int
    length: int
    decimals: int

    @property
    def type(self) -> str:
        if self.kind in "NF":
            return "long" if self.kind == "N" and self.decimals == 0 and self.length <= 18 else "double"
        return {"L": "boolean", "D": "date"}.get(self.kind, "string")

    def value(self, raw: bytes, encoding: str):
        text = raw.decode(encoding, "replace").strip(" \0") if self.type == "string" else raw.decode("ascii", "replace").strip(" \0")
        if not text:
            return None
        try:
            if self.type in ("long", "double"):
                return int(text) if self.type == "long" else float(text)
            if self.type == "date":
                return datetime.datetime.strptime(text, "%Y%m%d").date()
        except ValueError:  # stars and the like: no number or date was stored
            return None
        if self.type == "boolean":
            return {"Y": True, "T": True, "N": False, "F": False}.get(text.upper())
        return text


@dataclass
class Attributes:
    """The header of an attribute file."""

    records: int
    start: int
    length: int
    fields: list[Field]

    @classmethod
    def of(cls, head: bytes) -> Attributes:
        records, start, length = struct.unpack("<IHH", head[4:12])
        fields, at, taken = [], 1, {"record", "rings", "crs"}
        for k in range(32, start - 1, 32):
            if head[k] == 0x0D:
                break
            name = head[k : k + 11].split(b"\0")[0].decode("ascii", "replace").strip()
            while name.lower() in taken:
                name = f"attribute_{name}"
            taken.add(name.lower())
            fields.append(Field(name, chr(head[k + 11]), at, head[k + 16], head[k + 17]))
            at += head[k + 16]
        return cls(records, start, length, fields)

    def schema(self) -> str:
        return ", ".join(["record long", f"rings {RINGS}", "crs string", *(f"`{f.name}` {f.type}" for f in self.fields)])


def header_length(head: bytes) -> int:
    return struct.unpack("<H", head[8:10])[0]


def outline(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the rings, points) of a record's content."""
    kind = struct.unpack("<i", content[:4])[0]
    if kind == 0:
        return np.zeros(0, np.int32), np.zeros((0, 2))
    if kind not in POLYGONS:
        raise ValueError(f"a record isn't a polygon (kind {kind})")
    parts, points = struct.unpack("<ii", content[36:44])
    starts = np.frombuffer(content, "<i4", parts, 44)
    return starts, np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)


def batch_of(first: int, contents: list[bytes], rows: bytes, attributes: Attributes, crs: str | None, encoding: str) -> pa.RecordBatch:
    """Records from `first` on, with their rows of the attribute file; those marked as deleted are left out."""
    length = attributes.length
    lines = [rows[k * length : (k + 1) * length] for k in range(len(contents))]
    keep = [k for k, line in enumerate(lines) if line[:1] != b"*"]
    starts, points = zip(*(outline(contents[k]) for k in keep), strict=True) if keep else ((), ())
    sizes = [np.diff(np.append(s, len(p))) for s, p in zip(starts, points, strict=True)]
    flat = np.concatenate([np.zeros((0, 2)), *points])
    place = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], ["x", "y"])
    ring_ends = np.cumsum(np.concatenate([[0], *sizes]).astype(np.int64))
    rings = pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), place)
    shapes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sizes)]), pa.int32()), rings)
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string()}
    columns = [pa.array([f.value(lines[k][f.start : f.start + f.length], encoding) for k in keep], kinds[f.type]) for f in attributes.fields]
    names = ["record", "rings", "crs", *(f.name for f in attributes.fields)]
    return pa.RecordBatch.from_arrays([pa.array([first + k for k in keep], pa.int64()), shapes, pa.array([crs] * len(keep), pa.string()), *columns], names)


class Stretch(InputPartition):
    def __init__(self, first: int, records: int, start: int, end: int):
        self.first, self.records, self.start, self.end = first, records, start, end


def _stem(path: str) -> str:
    """The path without its ending, on this machine's file system."""
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in path:
        raise ValueError("polygon_file needs a path that all machines see as a file")
    return os.path.splitext(path)[0]


def _read(path: str, start: int = 0, length: int = -1) -> bytes:
    with open(path, "rb") as stream:
        stream.seek(start)
        return stream.read(length)


class ShapeReader(DataSourceReader):
    def __init__(self, stem: str, encoding: str, split: int):
        self.stem, self.encoding, self.split = stem, encoding, split
        self.attributes = _attributes(stem)
        self.crs = _read(f"{stem}.prj").decode("utf-8", "replace").strip() if os.path.exists(f"{stem}.prj") else None

    def partitions(self) -> Sequence[InputPartition]:
        index = np.frombuffer(_read(f"{self.stem}.shx", 100), ">i4").reshape(-1, 2).astype(np.int64) * 2  # in words of two bytes
        if len(index) != self.attributes.records:
            raise ValueError(f"{self.stem}: {len(index)} outlines, {self.attributes.records} rows of attributes")
        if not len(index):
            return [Stretch(0, 0, 0, 0)]
        starts, ends = index[:, 0], index[:, 0] + index[:, 1] + 8
        if (starts[1:] < ends[:-1]).any():
            raise ValueError(f"{self.stem}: the offset index isn't in order")
        cuts = np.unique(np.searchsorted(starts, np.arange(starts[0], ends[-1], self.split)))
        cuts = np.append(cuts[cuts < len(index)], len(index))
        return [Stretch(int(a), int(b - a), int(starts[a]), int(ends[b - 1])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        index = np.frombuffer(_read(f"{self.stem}.shx", 100 + 8 * partition.first, 8 * partition.records), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with open(f"{self.stem}.shp", "rb") as shapes, open(f"{self.stem}.dbf", "rb") as table:
            for at in range(0, partition.records, BATCH):
                contents = []
                for offset, length in index[at : at + BATCH].tolist():
                    shapes.seek(offset + 8)
                    contents.append(shapes.read(length))
                table.seek(self.attributes.start + (partition.first + at) * self.attributes.length)
                yield batch_of(partition.first + at, contents, table.read(len(contents) * self.attributes.length), self.attributes, self.crs, self.encoding)


def _attributes(stem: str) -> Attributes:
    return Attributes.of(_read(f"{stem}.dbf", 0, header_length(_read(f"{stem}.dbf", 0, 12))))


class ShapeSource(DataSource):
    """spark.read.format("polygon_file").load("….shp"); options encoding (of texts, utf-8) and split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "polygon_file"

    def schema(self) -> str:
        return _attributes(_stem(self.options["path"])).schema()

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(_stem(self.options["path"]), self.options.get("encoding", "utf-8"), int(self.options.get("split", SPLIT_BYTES)))


def polygon_file(spark: SparkSession, path: str, encoding: str = "utf-8", split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(ShapeSource)
    return spark.read.format("polygon_file").option("encoding", encoding).option("split", split).load(path)


def polygon_layers(spark: SparkSession, folder: str) -> list[str]:
    """The polygon files below a folder: the only one, or all, if each is named *_poly. Other choices aren't safe and are refused, as is a folder without any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.shp").load(folder)
    kinds = {r.path: int.from_bytes(r.kind or b"", "little") for r in files.select("path", F.substring("content", 33, 4).alias("kind")).collect()}
    found = sorted(p for p, kind in kinds.items() if kind in POLYGONS)
    if not kinds:
        raise ValueError(f"no shape file below {folder}")
    if len(found) == 1 or (found and all(p.lower().endswith("_poly.shp") for p in found)):
        return found
    raise ValueError("no polygon file" if not found else "several polygon files, and not all are named *_poly: " + ", ".join(found))


def polygon_archive(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """The polygon file in a zip archive, or those of several archives with the same attributes; each archive holds one. An archive is one task's, read member by member."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    heads = raw.mapInPandas(lambda frames: _archive_heads(frames), "path string, members int, head binary").filter("members > 0").collect()  # a header for each archive
    if not heads or any(r.members != 1 for r in heads):
        raise ValueError("no archive with a polygon file" if not heads else "an archive holds several polygon files")
    schemas = {Attributes.of(bytes(r["head"])).schema() for r in heads}
    if len(schemas) != 1:
        raise ValueError("the archives' attributes differ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for stem in _members(archive):
                        yield from _archived(archive, stem, encoding)

    return raw.select("content").mapInArrow(run, schemas.pop())


def _members(archive: zipfile.ZipFile) -> list[str]:
    return sorted(n[:-4] for n in archive.namelist() if n.lower().endswith(".shp"))


def _other(archive: zipfile.ZipFile, stem: str, ending: str) -> str | None:
    return next((n for n in archive.namelist() if n[:-4] == stem and n.lower().endswith(ending)), None)


def _archive_heads(frames):
    import pandas as pd

    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                stems, head = _members(archive), b""
                if stems and (name := _other(archive, stems[0], ".dbf")):
                    with archive.open(name) as table:
                        head = table.read(12)
                        head += table.read(header_length(head) - 12)
                rows.append((path, len(stems), head))
        yield pd.DataFrame(rows, columns=["path", "members", "head"])


def _archived(archive: zipfile.ZipFile, stem: str, encoding: str) -> Iterator[pa.RecordBatch]:
    shapes, table, projection = (_other(archive, stem, e) for e in (".shp", ".dbf", ".prj"))
    crs = archive.read(projection).decode("utf-8", "replace").strip() if projection else None
    with archive.open(shapes) as outlines, archive.open(table) as rows:
        head = rows.read(12)
        attributes = Attributes.of(head + rows.read(header_length(head) - 12))
        outlines.read(100)
        for first in range(0, attributes.records, BATCH):
            contents = []
            for _ in range(min(BATCH, attributes.records - first)):
                _, words = struct.unpack(">ii", outlines.read(8))
                contents.append(outlines.read(2 * words))
            yield batch_of(first, contents, rows.read(len(contents) * attributes.length), attributes, crs, encoding)
