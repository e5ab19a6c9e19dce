"""Incremental binning: sums and counts are additive, so cells can follow a stream.

An extension beyond batch surfaces.  The origin must be given, since a stream has no
extent; state grows with occupied cells, and with a watermark only with recent windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gridloom.operators.cells import cell_index
from gridloom.sources.points import is_finite


def stream_cells(points: DataFrame, x0: float, y0: float, res: float, time_col: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Running (ix, iy, s, c) of a stream of (x, y, v), per time window where a time column is named."""
    good = points.where(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("v")))
    keys = [cell_index(F.col("x"), x0, res).alias("ix"), cell_index(F.col("y"), y0, res).alias("iy")]
    if time_col:
        good = good.withWatermark(time_col, late)
        keys.insert(0, F.window(time_col, window).alias("window"))
    return good.groupBy(*keys).agg(F.sum("v").alias("s"), F.count("v").alias("c"))


def write_cells(cells: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keep the newest state of all cells in a Parquet folder, replaced batch by batch."""

    def put(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return cells.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).start()
