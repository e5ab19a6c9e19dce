"""Reading point tables: three columns, finite rows, projected coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.crs import project


def read_table(spark: SparkSession, path: str, value_col: str = "value", lon_col: str = "longitude", lat_col: str = "latitude") -> DataFrame:
    """(v, lon, lat) as doubles from Parquet (.parquet, .pq) or CSV with a header; text that is no number raises."""
    cols = (value_col, lon_col, lat_col)
    if path.rstrip("/").endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True)
    return df.select(*(F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, ("v", "lon", "lat"), strict=True)))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns are finite numbers."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & is_finite(F.col(c))
    return df.where(keep)


def project_points(df: DataFrame, src: int = 4326, work: int = 6933) -> DataFrame:
    """(x, y, v) in metres; rows that the projection sends to infinity are dropped."""
    x, y = project(F.col("lon"), F.col("lat"), src, work)
    return finite(df.select(x.alias("x"), y.alias("y"), "v"), "x", "y")


def extent(points: DataFrame) -> tuple[float, float, float, float, int]:
    """(min x, min y, max x, max y, count), in one pass."""
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
    if not r[4]:
        raise ValueError("No valid points after dropping rows that are not finite")
    return tuple(r)


def exact_sample(points: DataFrame, n: int, total: int, seed: int = 0) -> DataFrame:
    """Exactly min(n, total) of the ``total`` rows, at random and without replacement.

    A Bernoulli draw of a few more than n comes first, so that only about n rows are put
    in random order; it is repeated with more should it fall short.
    """
    if n >= total:
        return points
    more = n + 6 * math.sqrt(n) + 10
    while True:
        drawn = points.withColumn("turn", F.rand(seed)).where(F.col("turn") < min(1.0, more / total))
        if more >= total or drawn.count() >= n:
            return drawn.orderBy("turn", *points.columns).limit(n).select(*points.columns)
        more *= 2
