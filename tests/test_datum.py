"""Datum shifts by a correction table."""

from __future__ import annotations

import math

import numpy as np
import pytest

from geoledger.operators import datum

SOUTH, WEST, LAT, LON, SHAPE = 34.0, 136.0, 30 / 3600, 45 / 3600, (40, 50)


def mesh():
    r, c = np.mgrid[0 : SHAPE[0], 0 : SHAPE[1]]
    return 11.9 + 0.01 * np.sin(r / 5) + 0.003 * c, -10.4 + 0.02 * np.cos(c / 7) - 0.002 * r


def plain(table, lat, lon):
    r, c = (lat - SOUTH) / LAT, (lon - WEST) / LON
    i, j = min(int(r), SHAPE[0] - 2), min(int(c), SHAPE[1] - 2)
    a, b = r - i, c - j
    return (table[i, j] * (1 - a) * (1 - b) + table[i, j + 1] * (1 - a) * b + table[i + 1, j] * a * (1 - b) + table[i + 1, j + 1] * a * b) / 3600


@pytest.mark.parametrize("size", [6, 128])
def test_shift_and_its_inverse(spark, size):
    dlat, dlon = mesh()
    table = spark.createDataFrame([(int(i), int(j), float(dlat[i, j]), float(dlon[i, j])) for i in range(SHAPE[0]) for j in range(SHAPE[1])], "row long, col long, dlat double, dlon double")
    tiles = datum.correction_tiles(table, SHAPE, size)
    rng = np.random.default_rng(1)
    places = [(float(WEST + c * LON), float(SOUTH + r * LAT)) for r, c in zip(rng.uniform(1, SHAPE[0] - 2, 150), rng.uniform(1, SHAPE[1] - 2, 150), strict=True)] + [(WEST + 12 * LON, SOUTH + 6 * LAT), (WEST + 18 * LON, SOUTH + 12 * LAT)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "k long, lon double, lat double")
    args = (tiles, SHAPE, SOUTH, WEST, LAT, LON)
    there = datum.shifted(points, *args, size=size)
    for r in there.collect():
        lon, lat = places[r.k]
        assert (r.shifted_lat, r.shifted_lon) == (pytest.approx(lat + plain(dlat, lat, lon), abs=1e-12), pytest.approx(lon + plain(dlon, lat, lon), abs=1e-12)) and not r.shift_missing
    back = datum.shifted(there.selectExpr("k", "shifted_lon AS lon", "shifted_lat AS lat"), *args, inverse=True, size=size)
    for r in back.collect():
        lon, lat = places[r.k]
        metres = math.hypot((r.shifted_lat - lat) * 111_000, (r.shifted_lon - lon) * 91_000)
        assert metres < 1e-6  # a millimetre is asked for


def test_places_without_a_correction(spark):
    table = spark.createDataFrame([(r, c, 1.0, None if (r, c) == (2, 2) else 1.0) for r in range(5) for c in range(5)], "row long, col long, dlat double, dlon double")
    tiles = datum.correction_tiles(table, (5, 5))
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 1.5), (2, 9.0, 0.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 4.0, 4.0)], "k long, lon double, lat double")
    for inverse in (False, True):
        got = {r.k: (r.shifted_lon, r.shift_missing) for r in datum.shifted(points, tiles, (5, 5), 0.0, 0.0, 1.0, 1.0, inverse).collect()}
        assert got == {0: (pytest.approx(0.5 + (-1 if inverse else 1) / 3600), False), 5: (pytest.approx(4 + (-1 if inverse else 1) / 3600), False), **{k: (None, True) for k in (1, 2, 3, 4)}}
    assert datum.shifted(points.limit(0), tiles, (5, 5), 0.0, 0.0, 1.0, 1.0).count() == 0
