"""Readers with declared schemas: wide measurement CSV, mesh CSV, text grids and matrices, legends, JSON with comments."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number
from ..operators import ledger, reshape

MESH = ("CODE", "JCODE", "AVS", "ARV", "AVS_EB", "AVS_REF")


def wide_csv(spark: SparkSession, path: str, key: str, pairs: int, extra: Sequence[str] = ()) -> DataFrame:
    """A wide table with a byte-order mark: key, extra columns and numbered pairs, all as text; the key must be there and unique."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    wanted = [key, *extra, *(c for pair in reshape.pair_names(pairs) for c in pair)]
    df = ledger.require_columns(df, wanted).select(*(F.col(f"`{c}`") for c in wanted))
    ledger.assert_none(df, F.col(f"`{key}`").isNull(), f"{key} is missing")
    return ledger.assert_unique(df, [key], "wide table")


def mesh_csv(spark: SparkSession, path: str, codes: DataFrame | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
    """A national mesh table without a header: comments by #, - for null. The filter is by codes (a semi-join) or by their first digits."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MESH])
    df = spark.read.schema(schema).option("comment", "#").option("nullValue", "-").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    df = df.join(codes.select(F.col(codes.columns[0]).alias("CODE")), "CODE", "left_semi") if codes is not None else df
    df = df.filter(F.substring("CODE", 1, 4).isin(*prefixes)) if prefixes else df
    return ledger.assert_unique(df.select("CODE", *(number(F.col(c)).alias(c) for c in MESH[1:])), ["CODE"], "mesh table")


def grid_text(spark: SparkSession, path: str) -> DataFrame:
    """x, y: the first two columns of a white-space-separated grid."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(number(F.get(parts, F.lit(0))).alias("x"), number(F.get(parts, F.lit(1))).alias("y"))


def matrix_lines(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """row, values of a text matrix: a file, or a folder of part files in the order of their names, as `sinks.matrix` writes it. A line's row is
    the lines of the files and blocks before its own, and its place in its block; there is one count for each block that a task reads."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("id"), F.trim("value").alias("line"))
    blocks = lines.groupBy("file", "block").agg(F.count_if(F.col("line") != "").alias("n"), F.min("id").alias("first"))
    blocks = blocks.withColumn("before", F.sum("n").over(Window.orderBy("file", "block")) - F.col("n"))
    placed = lines.filter("line <> ''").join(blocks.select("file", "block", "before"), ["file", "block"])
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    out = placed.select((F.col("before") + inside - 1).alias("row"), F.transform(F.split("line", r"\s+"), number).alias("values"))
    if shape:
        ledger.assert_none(out.agg(F.count("*").alias("n"), F.count_if(F.size("values") != shape[1]).alias("odd")), (F.col("n") != shape[0]) | (F.col("odd") > 0), "the matrix has another shape")
    return out


def matrix_text(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """row, col, value of a text matrix, as `matrix_lines` reads it."""
    return matrix_lines(spark, path, shape).select("row", F.posexplode("values").alias("col", "value")).withColumn("col", F.col("col").cast("long"))


def mask_text(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """A matrix as 0 and 1: any finite value but zero is active."""
    return matrix_text(spark, path, shape).select("row", "col", F.when(F.coalesce(F.col("value") != 0, F.lit(False)), 1).otherwise(0).alias("value"))


def legend(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated legend, one row for each symbol."""
    df = spark.read.option("header", "true").option("sep", "\t").csv(path)
    return df.dropDuplicates([df.columns[0]])


def read_config(spark: SparkSession, path: str) -> dict:
    """JSON with comment lines and trailing commas."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)^\s*//.*$", "", text)))


def content_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of files: what an import compares before it adds or refuses a file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def exactly_one(spark: SparkSession, path: str, pattern: str) -> str:
    """The one file below a folder that fits a pattern; raises for none and for several."""
    found = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no file' if not found else 'several files'} fit {pattern}")
    return found[0]


def polygon_tiles(tiles: Sequence[DataFrame], reserved: Sequence[str] = ("x", "y", "depth"), prefix: str = "attribute_") -> DataFrame:
    """The rows of all tiles (rings, crs, attributes) as one layer: the reference systems must be one, empty shapes are dropped, a ring of fewer
    than three corners is refused, and attributes with reserved names are renamed."""
    ledger.assert_none(reduce(DataFrame.unionByName, [t.select(F.col("crs").cast("string")) for t in tiles]).distinct().agg(F.count("*").alias("n")), F.col("n") > 1, "tiles have several reference systems")
    named = [t.select(*(F.col(c).alias(f"{prefix}{c}" if c in reserved else c) for c in t.columns)) for t in tiles]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).filter(F.size("rings") > 0)
    return ledger.assert_none(whole, F.exists("rings", lambda r: F.size(r) < 3), "a shape isn't a polygon")


def prepared_layer(spark: SparkSession, path: str, key: str, required: Sequence[str]) -> DataFrame:
    """A prepared Parquet layer: required columns must be there and the key unique and present."""
    df = ledger.require_columns(spark.read.parquet(path), [key, *required])
    ledger.assert_none(df, F.col(key).isNull(), f"{key} is missing")
    return ledger.assert_unique(df, [key], "layer")


def import_changes(known: DataFrame, found: DataFrame) -> DataFrame:
    """name, status of files against a manifest (name, sha256): new, unchanged, or conflict where a known name has other contents; missing ones too."""
    k, f = known.select("name", F.col("sha256").alias("_known")), found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("sha256").alias("_found"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_found").isNull(), "missing").when(F.col("_known") == F.col("_found"), "unchanged").otherwise("conflict")
    return k.join(f, "name", "full").select("name", status.alias("status"))


def lookup_csv(spark: SparkSession, path: str, key: str, encoding: str = "windows-31j") -> DataFrame:
    """A lookup table in a national encoding, all as text without white space around it; the key must be there and unique."""
    raw = spark.read.format("binaryFile").load(path).mapInPandas(lambda frames: _decoded(frames, encoding), "line string")
    head = raw.first()  # the one header line
    names = [] if head is None else next(csv.reader([head["line"]]))
    fields = F.from_csv("line", ", ".join(f"`{c.strip()}` string" for c in names), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    df = ledger.require_columns(raw.filter(F.col("line") != head["line"]).select(fields.alias("r")).select("r.*"), [key])
    ledger.assert_none(df, F.col(key).isNull(), f"{key} is missing")
    return ledger.assert_unique(df, [key], "lookup table")


def _decoded(frames, encoding):
    import pandas as pd

    for frame in frames:
        for content in frame["content"]:
            lines = bytes(content).decode({"windows-31j": "cp932"}.get(encoding, encoding)).lstrip("\ufeff").splitlines()
            yield pd.DataFrame({"line": [x for x in lines if x.strip()]})


def property_sheets(spark: SparkSession, path: str, header_line: int = 4) -> DataFrame:
    """property, then the columns of all sheets, from a folder of CSV files (one a sheet, named after its property) whose header stands on a given line
    and is the same in each. What stands above it isn't data."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"^(.*)\.csv$", 1).alias("property"), F.split("value", r"\r?\n").alias("lines"))
    heads = lines.select(F.element_at("lines", header_line).alias("head")).distinct().limit(2).collect()
    if len(heads) != 1 or not heads[0]["head"]:
        raise ValueError("the sheets have no header, or several")
    schema = ", ".join(f"`{c.strip()}` string" for c in next(csv.reader([heads[0]["head"].lstrip("\ufeff")])))
    rows = lines.select("property", F.explode(F.slice("lines", header_line + 1, F.greatest(F.size("lines") - header_line, F.lit(0)))).alias("line")).filter(F.trim("line") != "")
    return rows.select("property", F.from_csv("line", schema).alias("r")).select("property", "r.*")
