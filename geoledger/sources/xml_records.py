"""Soil-test records from XML trees of unknown shape: one Spark task for each group of files, errors kept as rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

# Names under which a field may stand, first one first.
ALIASES = {
    "boring_id": ("boringid", "孔番号", "ボーリング番号", "ボーリング名", "ファイル名"),
    "x": ("x", "座標x", "坑口座標x", "平面直角x"),
    "y": ("y", "座標y", "坑口座標y", "平面直角y"),
    "latitude": ("latitude", "緯度"),
    "longitude": ("longitude", "経度"),
    "surface_z": ("surfacez", "孔口標高", "坑口標高", "標高"),
    "sample_id": ("sampleid", "試料id", "試料番号", "試料no", "試料ナンバー"),
    "sample_no": ("sampleno", "試料連番", "試料番号連番"),
    "depth_top": ("depthtop", "試料採取開始深度", "開始深度", "上端深度"),
    "depth_bottom": ("depthbottom", "試料採取終了深度", "終了深度", "下端深度"),
    "depth_mid": ("depthmid", "試料代表深度", "代表深度", "試料深度"),
    "elevation": ("samplez", "試料採取標高", "試料標高"),
    "soil_name": ("soilname", "土質名", "土質分類名", "地盤材料の分類名", "分類", "土質"),
    "soil_code": ("soilcode", "地盤材料の分類記号", "分類記号", "土質コード"),
    "test_type": ("testtype", "試験名", "試験種別", "強度試験", "試験条件", "せん断試験条件", "せん断試験条件コード"),
    "test_condition_code": ("せん断試験条件コード", "試験条件コード"),
    "test_condition": ("せん断試験条件", "試験条件"),
    "wet_density": ("湿潤密度",),
    "dry_density": ("乾燥密度",),
    "particle_density": ("土粒子密度",),
    "water_content": ("自然含水比",),
    "void_ratio": ("間隙比",),
    "degree_of_saturation": ("飽和度",),
    "gravel_fraction": ("礫分",),
    "sand_fraction": ("砂分",),
    "silt_fraction": ("シルト分",),
    "clay_fraction": ("粘土分",),
    "maximum_particle_size": ("最大粒径",),
    "d10": ("D10",),
    "d50": ("D50",),
    "uniformity_coefficient": ("均等係数",),
    "liquid_limit": ("液性限界",),
    "plastic_limit": ("塑性限界",),
    "plasticity_index": ("塑性指数",),
    "c_total": ("ctotal", "全応力粘着力", "粘着力全応力", "c全応力", "c"),
    "shear_strength_total": ("せん断強さ_全応力", "全応力せん断強さ"),
    "phi_total": ("phitotal", "全応力内部摩擦角", "内部摩擦角全応力", "φ全応力", "phi全応力", "せん断抵抗角_全応力"),
    "c_effective": ("ceffective", "有効応力粘着力", "粘着力有効応力", "c有効応力"),
    "shear_strength_effective": ("せん断強さ_有効応力", "有効応力せん断強さ"),
    "phi_effective": ("phieffective", "有効応力内部摩擦角", "内部摩擦角有効応力", "φ有効応力", "phi有効応力", "せん断抵抗角_有効応力"),
    "qu": ("qu", "一軸圧縮強さ", "一軸圧縮強度", "圧縮強さ"),
}
TEXTS = ("boring_id", "sample_id", "sample_no", "soil_name", "soil_code", "test_type", "test_condition_code", "test_condition")
RECORD, CONDITION = "試験情報", "せん断試験条件"
HINTS = ("sample", "試料", "strength", "強度", "triaxial", "三軸", "shear", "せん断")
_MARKS = re.compile(C.NAME_MARKS)


def _key(name: str) -> str:
    return _MARKS.sub("", re.sub(r"^.*\}", "", name).rpartition(":")[2]).casefold()


def _fields(node: ET.Element, skip: str | None = None) -> dict[str, str]:
    """Leaf texts and attributes below a node, the first of a name in document order; `skip`: subtrees left out."""
    out: dict[str, str] = {}
    stack = [node]
    while stack:
        e = stack.pop()
        if skip and e is not node and _key(e.tag) == skip:
            continue
        for name, value in ((e.tag, e.text), *e.attrib.items()):
            if value and value.strip():
                out.setdefault(_key(name), value.strip())
        stack += list(e)[::-1]
    return out


def _decoded(content: bytes) -> str:
    try:
        return content.decode("shift_jis")
    except UnicodeDecodeError:
        return content.decode("utf-8-sig")


#: Fields of which one makes a test a record of strength, and those that make any element one.
STRENGTH = ("c_total", "shear_strength_total", "phi_total", "c_effective", "shear_strength_effective", "phi_effective", "qu")
NAMED = ("c_total", "phi_total", "c_effective", "phi_effective", "qu")
DENSITY = ("wet_density", "dry_density")


def _holds(fields: dict[str, str], names: tuple[str, ...]) -> bool:
    return any(_key(alias) in fields for name in names for alias in ALIASES[name])


def parse(content: bytes, strength: bool = False) -> list[tuple[dict[str, str], str]]:
    """(fields, text) of each record: every RECORD element (strength: those with a strength field or a test's kind); where there are none, the
    innermost elements whose names hint at a test and that hold strength content; else the root (strength: if it holds any)."""
    root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", _decoded(content)))
    tests = [e for e in root.iter() if _key(e.tag) == _key(RECORD)]
    kinds = {_key(k) for k in ALIASES["test_type"]}
    records = tests if not strength else [e for e in tests if _holds(f := _fields(e), STRENGTH) or kinds & f.keys()]

    def content_of(e: ET.Element) -> bool:
        said = _MARKS.sub("", "".join(e.itertext())).casefold()
        return any(h in said for h in HINTS) or _holds(_fields(e), NAMED)

    if not records:
        hinted = [e for e in root.iter() if e is not root and any(h in _key(e.tag) for h in HINTS) and (len(e) or e.attrib) and content_of(e)]
        records = [e for e in hinted if not any(d is not e and d in hinted for d in e.iter())]
    if not records:
        parents = {child: parent for parent in root.iter() for child in parent}
        # a single value that hints at a test belongs to the element around it
        leaves = [e for e in root.iter() if e is not root and not len(e) and any(h in _key(e.tag) for h in HINTS)]
        records = list(dict.fromkeys(p for e in leaves if content_of(p := parents[e])))
        records = [e for e in records if not any(d is not e and d in records for d in e.iter())] or ([root] if content_of(root) or not strength else [])
    context: dict[str, str] = {}
    for child in root:
        if child not in records:
            for k, v in _fields(child, _key(RECORD)).items():
                context.setdefault(k, v)
    return [(context | _fields(e), " ".join(t.strip() for t in e.itertext() if t.strip())) for e in records]


def read_records(spark: SparkSession, path: str, strength: bool = False) -> DataFrame:
    """file, error, and the fields of each record; a file that can't be parsed is one row with its error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                file = name.rpartition("/")[2]
                try:
                    rows += [(file, None, fields, text) for fields, text in parse(content, strength)]
                except (ET.ParseError, ValueError) as e:
                    rows.append((file, f"{type(e).__name__}: {e}", {}, ""))
            yield pd.DataFrame(rows, columns=["file", "error", "fields", "text"])

    return typed(raw.select("path", "content").mapInPandas(run, "file string, error string, fields map<string,string>, text string"))


def typed(records: DataFrame) -> DataFrame:
    """The columns of ALIASES from the field maps, by built-in functions; depth_mid, test_type and elevation are derived."""
    fields = F.col("fields")
    out = records.withColumns({c: (lambda v, c=c: v if c in TEXTS else C.decimal_degrees(v) if c in ("latitude", "longitude") else C.safe_number(v))(C.first_of(fields, [_key(a) for a in aliases])) for c, aliases in ALIASES.items()})
    out = out.withColumns({c: F.coalesce(c, C.coordinate_from_parts(fields, base)) for c, base in (("latitude", "緯度"), ("longitude", "経度"))})
    condition = F.coalesce(fields[_key(CONDITION)], fields[_key(CONDITION + "コード")])
    kind = F.when(condition.isNotNull(), C.test_type(condition)).when(F.col("qu").isNotNull(), "一軸圧縮試験").otherwise(C.test_type(F.col("text")))
    out = out.withColumns({"depth_mid": F.coalesce("depth_mid", (F.col("depth_top") + F.col("depth_bottom")) / 2), "test_type": kind, "boring_id": F.coalesce("boring_id", F.regexp_replace("file", r"\.[^.]*$", ""))})
    return out.withColumn("elevation", F.coalesce("elevation", F.col("surface_z") - F.col("depth_mid"))).drop("fields", "text")


def presence_summary(records: DataFrame) -> DataFrame:
    """metric, value: records, and those that hold each strength field; one pass."""
    fields = ("c_total", "phi_total", "c_effective", "phi_effective", "qu")
    counts = records.filter("error IS NULL").agg(F.count("*").alias("strength_records"), *(F.count(c).alias(f"present_{c}") for c in fields))
    return counts.unpivot([], counts.columns, "metric", "value")
