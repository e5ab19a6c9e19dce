"""Rasters: orientation, quantisation, filling, and nearest-neighbour reprojection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.crs import project
from gridloom.functions.quantise import encode_support, encode_value
from gridloom.spec import NODATA, GridSpec


def north_up(cells: DataFrame, ny: int) -> DataFrame:
    """Row and column of a north-up raster in place of ix and iy."""
    rest = [c for c in cells.columns if c not in ("ix", "iy")]
    return cells.select((F.lit(ny) - 1 - F.col("iy")).cast("int").alias("row"), F.col("ix").cast("int").alias("col"), *rest)


def quantised(surface: DataFrame, scale: float) -> DataFrame:
    """(ix, iy, value_dn, support_dn) from percentiles ``pct`` and support ``sup`` in metres."""
    return surface.select("ix", "iy", encode_value(F.col("pct"), scale).alias("value_dn"), encode_support(F.col("sup")).alias("support_dn"))


def densify(raster: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every pixel, with the sentinel where the sparse raster has none."""
    n = raster.sparkSession.range(rows * cols)
    full = n.select(F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    bands = [c for c in raster.columns if c not in ("row", "col")]
    return full.join(raster, ["row", "col"], "left").select("row", "col", *(F.coalesce(c, F.lit(NODATA).cast("short")).alias(c) for c in bands))


def reprojected_grid(spec: GridSpec, work: int, out: int, spark) -> tuple[float, float, float, int, int]:
    """(left, top, pixel size, rows, cols) of the output raster.

    The corners and edge middles of the source are projected; square pixels are sized so
    that the diagonal has as many of them as in the source, and sides are rounded to whole
    pixels.
    """
    x1, y1 = spec.x0 + spec.nx * spec.res, spec.y0 + spec.ny * spec.res
    steps = [(a, b) for a in (0.0, 0.25, 0.5, 0.75, 1.0) for b in (0.0, 0.25, 0.5, 0.75, 1.0) if a in (0.0, 1.0) or b in (0.0, 1.0)]
    edge = spark.createDataFrame([(spec.x0 + a * (x1 - spec.x0), spec.y0 + b * (y1 - spec.y0)) for a, b in steps], "x double, y double")
    x, y = project(F.col("x"), F.col("y"), work, out)
    r = edge.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    pixel = math.hypot(r[2] - r[0], r[3] - r[1]) / math.hypot(spec.nx, spec.ny)
    return r[0], r[3], pixel, max(1, math.floor((r[3] - r[1]) / pixel + 0.5)), max(1, math.floor((r[2] - r[0]) / pixel + 0.5))


#: Rows and columns of an output grid that are broadcast at most; longer sides are joined by a shuffle.
BROADCAST_LINES = 2_000_000


def reproject_nearest(raster: DataFrame, spec: GridSpec, grid: tuple[float, float, float, int, int], work: int = 6933, out: int = 3857) -> DataFrame:
    """The raster (ix, iy, bands) on another grid: an output pixel has the bands of the cell in which its centre lies.

    In all known systems x follows from the longitude and y from the latitude alone.  So the
    centres of the output's columns give source columns and those of its rows source rows,
    two small tables that the occupied cells meet one after the other.  Cost follows the
    occupied cells, not the extent; pixels without a source cell are absent.
    """
    left, top, pixel, rows, cols = grid
    spark = raster.sparkSession
    bands = [c for c in raster.columns if c not in ("ix", "iy")]

    def lines(n: int, name: str, x: Column, y: Column, pick: int, origin: float, index: str, size: int) -> DataFrame:
        place = project(x, y, out, work)[pick]
        table = spark.range(n).select(F.col("id").cast("int").alias(name), F.floor((place - F.lit(float(origin))) / F.lit(float(spec.res))).cast("long").alias(index))
        table = table.where(f"{index} >= 0 and {index} < {size}")
        return F.broadcast(table) if n <= BROADCAST_LINES else table

    column = lines(cols, "col", F.lit(left) + (F.col("id") + 0.5) * F.lit(pixel), F.lit(0.0), 0, spec.x0, "ix", spec.nx)
    row = lines(rows, "row", F.lit(0.0), F.lit(top) - (F.col("id") + 0.5) * F.lit(pixel), 1, spec.y0, "iy", spec.ny)
    return raster.join(column, "ix").join(row, "iy").select("row", "col", *bands)
