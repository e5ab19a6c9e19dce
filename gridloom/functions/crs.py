"""Map projections as column expressions: WGS 84, equal-area EPSG:6933 and EPSG:3857."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS 84 ellipsoid, and the standard parallel of EPSG:6933.
A, FLATTENING, PARALLEL = 6378137.0, 1 / 298.257223563, 30.0
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)
K0 = math.cos(math.radians(PARALLEL)) / math.sqrt(1 - E2 * math.sin(math.radians(PARALLEL)) ** 2)


def authalic_q(sin_lat: float) -> float:
    return (1 - E2) * (sin_lat / (1 - E2 * sin_lat**2) - math.log((1 - E1 * sin_lat) / (1 + E1 * sin_lat)) / (2 * E1))


QP = authalic_q(1.0)
#: Latitude from authalic latitude: coefficients of sin 2b, 4b and 6b in powers of E2.
SERIES = (
    E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040,
    23 * E2**2 / 360 + 251 * E2**3 / 3780,
    761 * E2**3 / 45360,
)

Pair = tuple[Column, Column]


def _q(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.lit(1 - E2) * (s / (1 - F.lit(E2) * s * s) - F.log((1 - F.lit(E1) * s) / (1 + F.lit(E1) * s)) / F.lit(2 * E1))


def to_equal_area(lon: Column, lat: Column) -> Pair:
    return F.lit(A * K0) * F.radians(lon), F.lit(A) * _q(lat) / F.lit(2 * K0)


def from_equal_area(x: Column, y: Column) -> Pair:
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * F.lit(2 * K0 / (A * QP)))))
    lat = b + F.lit(SERIES[0]) * F.sin(2 * b) + F.lit(SERIES[1]) * F.sin(4 * b) + F.lit(SERIES[2]) * F.sin(6 * b)
    return F.degrees(x / F.lit(A * K0)), F.degrees(lat)


def to_mercator(lon: Column, lat: Column) -> Pair:
    return F.lit(A) * F.radians(lon), F.lit(A) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> Pair:
    return F.degrees(x / F.lit(A)), F.degrees(2 * F.atan(F.exp(y / F.lit(A))) - F.lit(math.pi / 2))


def _same(x: Column, y: Column) -> Pair:
    return x, y


FROM_DEGREES = {4326: _same, 6933: to_equal_area, 3857: to_mercator}
TO_DEGREES = {4326: _same, 6933: from_equal_area, 3857: from_mercator}


def project(x: Column, y: Column, src: int, dst: int) -> Pair:
    """Coordinates of one reference system in another."""
    for code in (src, dst):
        if code not in FROM_DEGREES:
            raise ValueError(f"unknown coordinate system EPSG:{code}; known: {sorted(FROM_DEGREES)}")
    if src == dst:
        return x, y
    return FROM_DEGREES[dst](*TO_DEGREES[src](x, y))
