"""Column expressions: all of them built-in functions, so that they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.80665
PHI_CAP, N_CAP = 40.0, 50.0
BLOCK_M = 10_000

# Texts that stand for a missing number, and punctuation that names are compared without.
MISSING = ("nan", "na", "n/a", "-", "欠測", "未測定")
NAME_MARKS = r"[\s_\-:/（）()。、．.]+"
# Test codes, then aliases in the order in which they are tried.
TEST_CODES = {"B0521": "UU", "B0522": "CU", "B0523": "CUb", "B0524": "CD"}
TEST_ALIASES = (("UU", ("uu", "非排水三軸", "非圧密非排水")), ("CUb", ("cub",)), ("CU", ("cu", "圧密非排水")), ("CD", ("cd", "圧密排水")), ("一軸圧縮試験", ("一軸圧縮", "一軸圧縮試験", "unconfined", "uniaxial")))
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def is_finite(c: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def number(c: Column) -> Column:
    """Text to a finite double, or null."""
    value = c.try_cast("double")
    return F.when(is_finite(value), value)


def upper_cap(c: Column, most: float = N_CAP) -> Column:
    """least() skips nulls; this doesn't."""
    return F.when(c.isNotNull(), F.least(c, F.lit(most)))


def clip(c: Column, least: float, most: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), c)))


def close(a: Column, b: Column, atol: float, rtol: float = 0.0) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def in_range(c: Column, least: float | None, most: float | None) -> Column:
    """Finite and inside inclusive limits; an open lower limit is 0, an open upper one none."""
    inside = is_finite(c) & (c >= (0.0 if least is None else least))
    return inside & (c <= most) if most is not None else inside


def phi_from_n(n: Column) -> Column:
    """Internal friction angle in degrees from a blow count."""
    return F.when(n.isNotNull(), F.least(F.sqrt(15 * F.greatest(n, F.lit(0.0))) + 15, F.lit(PHI_CAP)))


def unit_weights(wet: Column, dry: Column) -> tuple[Column, Column]:
    """Densities (g/cm3) to kN/m3: only positive finite ones, and neither where dry exceeds wet."""
    good = lambda c: F.when(is_finite(c) & (c > 0), c * GRAVITY)
    w, d = good(wet), good(dry)
    clash = F.coalesce(d > w, F.lit(False))
    return F.when(~clash, w), F.when(~clash, d)


def safe_number(c: Column) -> Column:
    """The first number anywhere in a text, without thousands separators; null for missing marks and texts without one."""
    cleaned = F.regexp_replace(F.trim(c), ",", "")
    found = F.regexp_extract(cleaned, NUMBER, 0)
    return F.when((cleaned != "") & ~F.lower(cleaned).isin(*MISSING) & (found != ""), found.try_cast("double"))


def number_or_text(c: Column) -> tuple[Column, Column]:
    """(number, text): a field as safe_number has it, and the trimmed text where it holds no number and isn't a missing mark."""
    n, text = safe_number(c), F.trim(c)
    return n, F.when(n.isNull() & (text != "") & ~F.lower(F.regexp_replace(text, ",", "")).isin(*MISSING), text)


def coordinate_from_parts(fields: Column, base: str) -> Column:
    """Degrees from three fields of a map, base with 度, 分 and 秒; null unless all three are there."""
    parts = [fields[f"{base}{part}"] for part in ("度", "分", "秒")]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), decimal_degrees(F.concat_ws(" ", *parts)))


def file_name(c: Column, longest: int = 120) -> Column:
    """A safe file name: marks that systems refuse become _, runs of them one; unnamed where nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(c), r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(F.coalesce(cleaned, F.lit("")) == "", "unnamed").otherwise(F.substring(cleaned, 1, longest))


def normalized(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, NAME_MARKS, ""))


def local_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^.*\}", ""), r"^[^:]*:", "")


def first_of(fields: Column, aliases: Sequence[str]) -> Column:
    """The value of the first alias that a map has."""
    return F.coalesce(*(fields[a] for a in aliases))


def test_type(c: Column) -> Column:
    """A code, else the first kind with an alias in the text, else the text, else unknown."""
    code, name = F.upper(F.trim(c)), normalized(c)
    out = F.when(code == next(iter(TEST_CODES)), TEST_CODES[next(iter(TEST_CODES))])
    for k, v in list(TEST_CODES.items())[1:]:
        out = out.when(code == k, v)
    for kind, aliases in TEST_ALIASES:
        hit = F.lit(False)
        for a in aliases:
            hit = hit | F.contains(name, F.lit(a))
        out = out.when(hit, kind)
    return out.when(F.trim(c) != "", F.trim(c)).otherwise("unknown")


def decimal_degrees(c: Column) -> Column:
    """Degrees, minutes and seconds in one text, or a decimal."""
    parts = F.regexp_extract_all(c, F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1))
    at = lambda i: F.get(parts, F.lit(i)).cast("double")
    sign = F.when(at(0) < 0, -1.0).otherwise(1.0)
    return F.when(F.size(parts) >= 3, sign * (F.abs(at(0)) + at(1) / 60 + at(2) / 3600)).otherwise(safe_number(c))


def meshcode_250m(longitude: Column, latitude: Column) -> Column:
    """The ten digits of the 250 m mesh; null outside 100..180 E, 0..66 N."""
    a, o = latitude * 1.5, longitude - 100.0
    first_a, first_o = F.floor(a), F.floor(o)
    fa, fo = (a - first_a) * 8.0, (o - first_o) * 8.0
    second_a, second_o = F.least(F.floor(fa), F.lit(7)), F.least(F.floor(fo), F.lit(7))
    fa, fo = (fa - second_a) * 10.0, (fo - second_o) * 10.0
    third_a, third_o = F.least(F.floor(fa), F.lit(9)), F.least(F.floor(fo), F.lit(9))
    fa, fo = fa - third_a, fo - third_o
    half = lambda y, x: 1 + (x >= 0.5).cast("int") + 2 * (y >= 0.5).cast("int")
    fourth = half(fa, fo)
    fa, fo = fa * 2.0, fo * 2.0
    fifth = half(fa - F.floor(fa), fo - F.floor(fo))
    code = F.concat(F.lpad(first_a.cast("string"), 2, "0"), F.lpad(first_o.cast("string"), 2, "0"), *(x.cast("string") for x in (second_a, second_o, third_a, third_o, fourth, fifth)))
    return F.when((longitude >= 100) & (longitude < 180) & (latitude >= 0) & (latitude < 66), code)


def block_key(x: Column, y: Column, size: float = BLOCK_M) -> Column:
    return F.concat_ws(":", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def grid_index(c: Column, least: float, step: float) -> Column:
    """The nearest grid line, halves to even."""
    return F.rint((c - least) / step).cast("long")


def on_grid(c: Column, index: Column, least: float, step: float, atol: float = 1e-4) -> Column:
    return close(c, least + index * step, atol)


def code_text(c: Column) -> Column:
    """A numeric code as text without a fraction; UNKNOWN for null."""
    return F.coalesce(c.cast("long").cast("string"), F.lit("UNKNOWN"))


def invalid_ground(jcode: Column, avs30: Column, arv: Column | None = None) -> Column:
    """Whether a mesh row's attributes are sentinels; all of them become null then."""
    bad = jcode.isNull() | (jcode == 0) | avs30.isNull() | (avs30 <= 0)
    return bad | arv.isNull() | (arv <= 0) if arv is not None else bad
