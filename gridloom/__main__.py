"""Command line: python -m gridloom INPUT [options]."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

import gridloom
from gridloom.plans.pipeline import AUTO, Pipeline


#: The names, defaults and choices of the options are fixed values.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gridloom", description="Gap-filled, capped surfaces from scattered points.")
    p.add_argument("input", help="CSV with a header, or Parquet (.parquet, .pq)")
    p.add_argument("-o", "--out", default="examples", help="folder for all results")
    p.add_argument("--value-col", default="value")
    p.add_argument("--lng-col", default="longitude")
    p.add_argument("--lat-col", default="latitude")
    p.add_argument("--res", type=float, default=500.0, help="width of a cell on the ground, in m")
    p.add_argument("--cap-km", default=AUTO, help="how far values reach from data, in km; auto takes the calibrated distance")
    p.add_argument("--transform", default=AUTO, choices=[AUTO, "identity", "log10", "sqrt", "percentile"])
    p.add_argument("--saturation", type=float, default=1.0, help="how many points make a cell rely on them alone")
    p.add_argument("--block", type=int, default=2048, help="cells along the side of a tile")
    p.add_argument("--workers", type=int, default=4, help="local threads, where no cluster is named")
    p.add_argument("--scale", type=float, default=100, help="stored steps per percent")
    p.add_argument("--compress", default="ZSTD", help="codec of the Parquet raster")
    p.add_argument("--calib-max-points", type=int, default=2_000_000)
    p.add_argument("--calibration", help="calibration file to use or make")
    p.add_argument("--src-crs", type=int, default=4326)
    p.add_argument("--work-crs", type=int, default=6933)
    p.add_argument("--out-crs", type=int, default=3857)
    p.add_argument("--skip-calibration", action="store_true")
    p.add_argument("--normalise", action="store_true", help="empty coarse cells carry no weight")
    p.add_argument("--version", action="version", version=gridloom.__version__)
    return p


def main(argv: Sequence[str] | None = None) -> str:
    p = parser()
    a = vars(p.parse_args(argv))
    for name, ok in (("res", a["res"] > 0), ("workers", a["workers"] >= 1), ("scale", a["scale"] > 0), ("block", a["block"] >= 1)):
        if not ok:
            p.error(f"--{name} is too small")
    if a["cap_km"] == AUTO:
        a["cap_km"] = None
    else:
        try:
            a["cap_km"] = float(a["cap_km"])
        except ValueError:
            p.error("--cap-km must be a number or auto")
    builder = SparkSession.builder.appName("gridloom")
    if "MASTER" not in os.environ and not SparkSession.getActiveSession():
        builder = builder.master(f"local[{a['workers']}]")
    path = Pipeline(builder.getOrCreate(), **a).run()
    print(path)
    return path


if __name__ == "__main__":
    main()
