"""Cells: binning, the sum pyramid, upsampling, box counts and tiles, as DataFrame plans.

A cell table has columns ix, iy (long), s (double) and c (long); an absent cell is (0, 0).
``keys`` names further columns, such as a fold, that separate independent grids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_index(coordinate: Column, origin: float, res: float) -> Column:
    return F.floor((coordinate - F.lit(float(origin))) / F.lit(float(res))).cast("long")


def bin_points(points: DataFrame, x0: float, y0: float, res: float, value: str = "v", keys: Sequence[str] = (), shape: tuple[int, int] | None = None) -> DataFrame:
    """Sum and count of the values in each cell; summed per task before the only shuffle.

    With ``shape``, a point outside [0, nx) x [0, ny) raises.
    """
    ix, iy = cell_index(F.col("x"), x0, res), cell_index(F.col("y"), y0, res)
    if shape:
        inside = (ix >= 0) & (ix < shape[0]) & (iy >= 0) & (iy < shape[1])
        ix = F.when(inside, ix).otherwise(F.raise_error(F.concat(F.lit("indices out of range: "), ix.cast("string"), F.lit(", "), iy.cast("string"))).cast("long"))
    return points.select(*keys, ix.alias("ix"), iy.alias("iy"), F.col(value).alias("v")).groupBy(*keys, "ix", "iy").agg(F.sum("v").alias("s"), F.count("v").alias("c"))


def downsample_sum(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """2 x 2 sums: the next coarser level."""
    return cells.select(*keys, F.shiftright("ix", 1).alias("ix"), F.shiftright("iy", 1).alias("iy"), "s", "c").groupBy(*keys, "ix", "iy").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


#: Levels summed at once, and bytes of input for a task of them.
STEP, TASK_BYTES = 5, 2 << 20


def pyramid(cells: DataFrame, levels: int, keys: Sequence[str] = ()) -> DataFrame:
    """All levels 0..levels stacked, with a column ``level``.

    Cells are dealt by the coarsest cell they belong to, so that all levels are summed where
    they are: one shuffle of the cells as they come, instead of one of every level's.  The
    number of tasks follows the input, and with it what one of them holds.  More than STEP
    levels go on from the last of these, so that a coarsest cell stays small.
    """
    step = min(levels, STEP)
    spark = cells.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    size = int(str(cells._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(1, size // TASK_BYTES if size < 1 << 60 else most)  # rows that the driver made have no known size
    above = [F.shiftright(c, step).alias(f"_{c}") for c in ("ix", "iy")]
    dealt = cells.select(*keys, *above, "ix", "iy", "s", "c").repartition(tasks, *keys, "_ix", "_iy")
    every = dealt.select(*keys, "_ix", "_iy", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("level"), "ix", "iy", "s", "c")
    out = every.groupBy(*keys, "_ix", "_iy", "level", F.expr("shiftright(ix, level)").alias("ix"), F.expr("shiftright(iy, level)").alias("iy")).agg(F.sum("s").alias("s"), F.sum("c").alias("c")).drop("_ix", "_iy")
    if levels == step:
        return out
    rest = pyramid(out.where(F.col("level") == step).drop("level"), levels - step, keys).where("level > 0")
    return out.unionByName(rest.withColumn("level", F.col("level") + step))


def upsample_nearest(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each cell becomes 2 x 2 equal ones; all value columns pass through."""
    half = F.array(F.lit(0), F.lit(1))
    rest = [c for c in grid.columns if c not in ("ix", "iy", *keys)]
    wide = grid.withColumn("dx", F.explode(half)).withColumn("dy", F.explode(half))
    return wide.select(*keys, (2 * F.col("ix") + F.col("dx")).alias("ix"), (2 * F.col("iy") + F.col("dy")).alias("iy"), *rest)


def _upsample_axis(grid: DataFrame, axis: str, other: str, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Even child: 3/4 own and 1/4 the cell before; odd child: 3/4 own and 1/4 the cell after; the border repeats."""
    w = Window.partitionBy(*keys, other).orderBy(axis)
    sides = grid
    for c in columns:
        sides = sides.withColumn(f"{c}_0", F.coalesce(F.lag(c).over(w), c)).withColumn(f"{c}_1", F.coalesce(F.lead(c).over(w), c))
    two = sides.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
    mixed = [(0.75 * F.col(c) + 0.25 * F.when(F.col("d") == 0, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1"))).alias(c) for c in columns]
    return two.select(*keys, (2 * F.col(axis) + F.col("d")).alias(axis), other, *mixed)


def upsample_bilinear(grid: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Smooth 2x refinement of a dense grid, one axis after the other; windows only, no join."""
    return _upsample_axis(_upsample_axis(grid, "ix", "iy", columns, keys), "iy", "ix", columns, keys)


def box_count(cells: DataFrame, radius: int, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Points within ``radius`` cells on both axes, for every cell of the grid with any: (ix, iy, n).

    One axis after the other: a cell's count begins ``radius`` cells before it and ends as
    many after it, so running sums over these two steps per cell give the counts of whole
    stretches at once, whatever the radius; only cells of the result are written out.
    """
    out = cells.select(*keys, "ix", "iy", F.col("c").alias("n"))
    for axis, other, size in (("ix", "iy", shape[0]), ("iy", "ix", shape[1])):
        begin = F.struct(F.greatest(F.col(axis) - radius, F.lit(0)).cast("long").alias("at"), F.col("n").alias("d"))
        end = F.struct((F.col(axis) + radius + 1).cast("long").alias("at"), (-F.col("n")).alias("d"))
        steps = out.select(*keys, other, F.explode(F.array(begin, end)).alias("step")).groupBy(*keys, other, F.col("step.at").alias("at")).agg(F.sum("step.d").alias("d"))
        line = Window.partitionBy(*keys, other).orderBy("at")
        level = steps.select(*keys, other, "at", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("at").over(line).alias("until"))
        stretch = F.sequence("at", F.least("until", F.lit(size)) - 1)
        out = level.where((F.col("n") > 0) & (F.col("at") < size)).select(*keys, F.explode(stretch).alias(axis), other, "n")
    return out.select(*keys, "ix", "iy", "n")


def to_tiles(cells: DataFrame, tile: int, halo: int, shape: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Each cell once for every tile whose window, the tile with its halo, holds it: columns tx, ty.

    Tiles without any cell in their window don't appear.
    """
    def tiles(axis: str, n: int) -> Column:
        last = -(-n // tile) - 1
        low = F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / F.lit(tile))).cast("int")
        high = F.least(F.lit(last), F.floor((F.col(axis) + halo) / F.lit(tile))).cast("int")
        return F.explode(F.sequence(low, high))

    rest = [c for c in cells.columns if c not in keys]
    return cells.select(*keys, *rest, tiles("ix", shape[0]).alias("tx")).select(*keys, *rest, "tx", tiles("iy", shape[1]).alias("ty"))
