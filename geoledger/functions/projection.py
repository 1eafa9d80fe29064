"""Plane coordinates: the published Gauss-Krueger series, and the shift of the old Tokyo datum, as built-in functions only."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import is_finite, number

# Ellipsoids (semi-major axis in metres, inverse flattening), the shift from Tokyo to the geocentric datums
# (metres), and the datum codes of the records.
GRS80 = (6378137.0, 298.257222101)
BESSEL = (6377397.155, 299.152813)
TOKYO_SHIFT = (-146.414, 507.337, 680.507)
DATUMS = {"00": "Tokyo", "01": "JGD2000", "02": "JGD2011"}


@dataclasses.dataclass(frozen=True)
class Zone:
    """A plane rectangular zone: its origin in degrees and its scale. x points east and y north."""

    lon: float
    lat: float
    scale: float = 0.9999


#: Zone VII of the Japanese plane rectangular system.
ZONE_7 = Zone(137 + 10 / 60, 36.0)


def _n() -> float:
    return 1 / (2 * GRS80[1] - 1)


def _poly(*by_power: tuple[int, float]) -> float:
    return sum(c * _n() ** p for p, c in by_power)


def forward_terms() -> list[float]:
    """Coefficients from the conformal sphere to the plane, to the fifth power of the third flattening."""
    return [
        _poly((1, 1 / 2), (2, -2 / 3), (3, 5 / 16), (4, 41 / 180), (5, -127 / 288)),
        _poly((2, 13 / 48), (3, -3 / 5), (4, 557 / 1440), (5, 281 / 630)),
        _poly((3, 61 / 240), (4, -103 / 140), (5, 15061 / 26880)),
        _poly((4, 49561 / 161280), (5, -179 / 168)),
        _poly((5, 34729 / 80640)),
    ]


def inverse_terms() -> list[float]:
    return [
        _poly((1, 1 / 2), (2, -2 / 3), (3, 37 / 96), (4, -1 / 360), (5, -81 / 512)),
        _poly((2, 1 / 48), (3, 1 / 15), (4, -437 / 1440), (5, 46 / 105)),
        _poly((3, 17 / 480), (4, -37 / 840), (5, -209 / 4480)),
        _poly((4, 4397 / 161280), (5, -11 / 504)),
        _poly((5, 4583 / 161280)),
    ]


def latitude_terms() -> list[float]:
    """Coefficients from the conformal latitude to the geodetic one."""
    return [
        _poly((1, 2), (2, -2 / 3), (3, -2), (4, 116 / 45), (5, 26 / 45), (6, -2854 / 675)),
        _poly((2, 7 / 3), (3, -8 / 5), (4, -227 / 45), (5, 2704 / 315), (6, 2323 / 945)),
        _poly((3, 56 / 15), (4, -136 / 35), (5, -1262 / 105), (6, 73814 / 2835)),
        _poly((4, 4279 / 630), (5, -332 / 35), (6, -399572 / 14175)),
        _poly((5, 4174 / 315), (6, -144838 / 6237)),
        _poly((6, 601676 / 22275)),
    ]


def radius(zone: Zone) -> float:
    """The scaled radius of the rectifying sphere."""
    return zone.scale * GRS80[0] / (1 + _n()) * _poly((0, 1), (2, 1 / 4), (4, 1 / 64))


def arc(zone: Zone) -> float:
    """The scaled meridian arc from the equator to the zone's origin."""
    terms = [_poly((0, 1), (2, 1 / 4), (4, 1 / 64)), _poly((1, -3 / 2), (3, 3 / 16), (5, 3 / 128)), _poly((2, 15 / 16), (4, -15 / 64)), _poly((3, -35 / 48), (5, 175 / 768)), _poly((4, 315 / 512)), _poly((5, -693 / 1280))]
    phi = math.radians(zone.lat)
    return zone.scale * GRS80[0] / (1 + _n()) * (terms[0] * phi + sum(t * math.sin(2 * j * phi) for j, t in enumerate(terms[1:], 1)))


def to_plane(lon: Column, lat: Column, zone: Zone = ZONE_7) -> tuple[Column, Column]:
    """(x, y) in metres of degrees on GRS80. Null where a coordinate is null."""
    e = 2 * math.sqrt(_n()) / (1 + _n())
    s, d = F.sin(F.radians(lat)), F.radians(lon - zone.lon)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(forward_terms(), 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return radius(zone) * east, radius(zone) * north - arc(zone)


def from_plane(x: Column, y: Column, zone: Zone = ZONE_7) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees on GRS80 of metres in the plane."""
    xi, eta = (y + arc(zone)) / radius(zone), x / radius(zone)
    a, b = xi, eta
    for j, c in enumerate(inverse_terms(), 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, c in enumerate(latitude_terms(), 1):
        phi = phi + c * F.sin(2 * j * chi)
    return zone.lon + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(phi)


def from_tokyo(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees of the Tokyo datum as degrees on GRS80: to the ellipsoid's space coordinates at height 0, shifted, and back (Bowring)."""
    a, f = BESSEL[0], 1 / BESSEL[1]
    e2 = f * (2 - f)
    p, q = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    x, y, z = n * F.cos(p) * F.cos(q) + TOKYO_SHIFT[0], n * F.cos(p) * F.sin(q) + TOKYO_SHIFT[1], n * (1 - e2) * F.sin(p) + TOKYO_SHIFT[2]
    a, f = GRS80[0], 1 / GRS80[1]
    b, e2 = a * (1 - f), f * (2 - f)
    r = F.hypot(x, y)
    u = F.atan2(z * a, r * b)
    phi = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(u), 3), r - e2 * a * F.pow(F.cos(u), 3))
    return F.degrees(F.atan2(y, x)), F.degrees(phi)


def project_records(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude", datum: str = "datum_code", zone: Zone = ZONE_7) -> tuple[DataFrame, DataFrame]:
    """(records with x and y, records left out with exclusion_reason). Left out are coordinates that are missing, no numbers or out of range. A
    datum code that isn't known, or a place that the projection can't give, fails the job: a guess would move the record by hundreds of metres."""
    told = df.withColumns({"_lon": number(F.col(longitude).cast("string")), "_lat": number(F.col(latitude).cast("string"))})
    valid = F.coalesce(F.col("_lon").between(-180, 180) & F.col("_lat").between(-90, 90), F.lit(False))
    # steps of their own: written as one expression each step would repeat the one before it many times
    moved = from_tokyo(F.col("_lon"), F.col("_lat"))
    old = F.col(datum) == "00"
    placed = told.filter(valid).withColumns({"_lon": F.when(old, moved[0]).otherwise(F.col("_lon")), "_lat": F.when(old, moved[1]).otherwise(F.col("_lat"))})
    placed = placed.withColumns(dict(zip("xy", to_plane(F.col("_lon"), F.col("_lat"), zone), strict=True)))
    known = F.assert_true(F.coalesce(F.col(datum).isin(*DATUMS), F.lit(False)), F.lit("the datum code isn't known"))
    sure = lambda c: F.when(known.isNull() & F.assert_true(is_finite(F.col(c)), F.lit("a projected coordinate is not finite")).isNull(), F.col(c))
    kept = placed.withColumns({c: sure(c) for c in "xy"}).drop("_lon", "_lat")
    return kept, told.filter(~valid).drop("_lon", "_lat").withColumn("exclusion_reason", F.lit("invalid_coordinates"))
