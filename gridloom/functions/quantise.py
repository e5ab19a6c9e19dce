"""Encoding of surfaces to 16-bit numbers and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.spec import NODATA

#: Steps per octave of support, its floor in km, and the greatest number used.
SUPPORT_STEPS, SUPPORT_FLOOR_KM, SUPPORT_LIMIT = 8, 1e-3, 32000


def encode_value(percentile: Column, scale: float) -> Column:
    """Percentile times scale, half to even."""
    return F.rint(F.round(percentile * F.lit(float(scale)), 9)).cast("short")


def encode_support(metres: Column) -> Column:
    """log2 of the support in km in eighths, half to even."""
    n = F.rint(F.round(F.log2(F.greatest(metres / F.lit(1000.0), F.lit(SUPPORT_FLOOR_KM))) * SUPPORT_STEPS, 9))
    return F.least(F.greatest(n, F.lit(float(-SUPPORT_LIMIT))), F.lit(float(SUPPORT_LIMIT))).cast("short")


def masked(number: Column, near: Column) -> Column:
    """The number inside the cap, the sentinel outside."""
    return F.when(near, number).otherwise(F.lit(NODATA)).cast("short")


def decode_value(number: Column, scale: float) -> Column:
    return F.when(number != NODATA, number / F.lit(float(scale)))


def decode_support(number: Column) -> Column:
    """Support in km."""
    return F.when(number != NODATA, F.pow(F.lit(2.0), number / F.lit(float(SUPPORT_STEPS))))
