"""From a point file to a calibrated, capped and quantised surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.transforms import PercentileTransform, Transform, make_transform, transforms
from gridloom.operators.calibrate import calibrate_fill_cap, choose_transform
from gridloom.operators.cells import bin_points
from gridloom.operators.raster import north_up, quantised, reproject_nearest, reprojected_grid
from gridloom.operators.surface import surface
from gridloom.sources import sinks
from gridloom.sources.points import exact_sample, extent, finite, project_points, read_table
from gridloom.spec import GridSpec, check_scale

#: The cap in km where nothing was calibrated, and the names of automatic choices.
UNCALIBRATED_CAP_KM, AUTO = 64.0, "auto"
DECODING = {"value": "percentile = DN / scale", "support": "km = 2 ** (DN / 8)"}


class Pipeline:
    """Stages ingest, calibrate, grid and run; each may be called alone, in this order.

    A calibration file that exists is used as it is; else one is made, unless skipped, and
    written.  An explicit transform or cap overrides the calibrated one.  A forced transform
    is checked against the data and always inverted with its own state.
    """

    def __init__(
        self,
        spark: SparkSession,
        input: str,
        out: str = "surface",
        value_col: str = "value",
        lng_col: str = "longitude",
        lat_col: str = "latitude",
        res: float = 500.0,
        cap_km: float | None = None,
        transform: str = AUTO,
        saturation: float = 1.0,
        block: int = 2048,
        workers: int = 4,
        scale: float = 100,
        compress: str = "ZSTD",
        calib_max_points: int = 2_000_000,
        calibration: str | None = None,
        src_crs: int = 4326,
        work_crs: int = 6933,
        out_crs: int = 3857,
        skip_calibration: bool = False,
        normalise: bool = False,
        geotiff: bool = True,
        calibration_options: dict | None = None,
    ) -> None:
        check_scale(scale)
        if transform != AUTO and transform not in {t.name for t in transforms()}:
            raise ValueError(f"Unknown transform: {transform!r}")
        self.__dict__.update({k: v for k, v in locals().items() if k not in ("self", "__class__")})
        self.document: dict = {}

    # -- stages -----------------------------------------------------------------
    def ingest(self) -> DataFrame:
        """Finite points in working coordinates; an input without any raises."""
        table = finite(read_table(self.spark, self.input, self.value_col, self.lng_col, self.lat_col), "v", "lon", "lat")
        self.points = project_points(table, self.src_crs, self.work_crs).persist()
        self.extent = extent(self.points)
        return self.points

    def calibrate(self) -> dict:
        if self.calibration and sinks.exists(self.spark, self.calibration):
            self.document = sinks.read_json(self.spark, self.calibration)
        elif not self.skip_calibration:
            self.document = self.calibrated()
            sinks.write_json(self.spark, self.document, self.calibration or f"{self.out}/calibration.json")
        doc = self.document
        name = self.transform if self.transform != AUTO else doc.get("transform", "identity")
        state = doc.get("transform_state") or {}
        self.tf = self.fitted(name, state if state.get("name") == name else {"name": name})
        known = doc.get("percentile_quantiles")
        self.percentile = PercentileTransform(known) if known else PercentileTransform().fit(self.points, "v")
        cap = self.cap_km if self.cap_km is not None else doc.get("cap_km")
        self.cap = float(UNCALIBRATED_CAP_KM if cap is None else cap)
        return doc

    def fitted(self, name: str, state: dict) -> Transform:
        t = make_transform(state)
        if name == "percentile" and t.quantiles is None:
            t = t.fit(self.points, "v")
        least = self.points.agg(F.min("v")).first()[0]
        if not t.valid(least):
            raise ValueError(f"transform {name} does not apply to values from {least}")
        return t

    def calibrated(self) -> dict:
        n = self.extent[4]
        sample = exact_sample(self.points, self.calib_max_points, n).persist()
        best, scores = choose_transform(sample)
        cap, detail = calibrate_fill_cap(sample.select("x", "y", best.fwd(F.col("v")).alias("v")), **(self.calibration_options or {}))
        return {
            "transform": best.name,
            "n_calibration_points": min(n, self.calib_max_points),
            "transform_scores": {name: {"mean": mean, **per} for name, mean, per in scores},
            "transform_state": best.state(),
            "percentile_quantiles": PercentileTransform().fit(self.points, "v").quantiles.tolist(),
            "cap_km": cap,
            "cv": {str(b): {"overall_skill": d["overall_skill"], "cap_km": cap} for b, d in detail.items()},
        }

    def grid(self) -> GridSpec:
        """The geometry; a halo wider than a tile raises.

        ``block`` is the greatest side of a tile.  Results don't depend on it, so tiles are
        halved, down to twice their halo, while there are fewer than two for each core.
        """
        about = lambda block: GridSpec.from_extent(self.extent[:4], self.res, self.cap, block=block, saturation=self.saturation, scale=self.scale)
        spec = about(self.block)
        while -(-spec.nx // spec.tile) * -(-spec.ny // spec.tile) < 2 * self.spark.sparkContext.defaultParallelism and spec.tile // 2 >= 2 * spec.halo:
            spec = about(spec.tile // 2)
        self.spec = spec
        return spec

    def raster(self) -> DataFrame:
        """(ix, iy, value_dn, support_dn) of all cells within the cap: one lazy plan."""
        tv = self.points.select("x", "y", self.tf.fwd(F.col("v")).alias("tv"))
        cells = bin_points(tv, self.spec.x0, self.spec.y0, self.res, "tv")
        out = surface(cells, self.spec, normalise=self.normalise)
        value = out.select("ix", "iy", self.tf.inv(F.col("val")).alias("v"), "sup")
        return quantised(value.select("ix", "iy", self.percentile.fwd(F.col("v")).alias("pct"), "sup"), self.scale)

    def run(self) -> str:
        """All stages; writes ``<out>/raster``, its metadata and, unless ``geotiff`` is off, ``<out>/value.tif`` and ``support.tif``, and returns the raster's path."""
        self.ingest()
        try:
            self.calibrate()
            spec = self.grid()
            sparse = self.raster()
            if self.out_crs != self.work_crs:
                left, top, pixel, rows, cols = grid = reprojected_grid(spec, self.work_crs, self.out_crs, self.spark)
                sparse = reproject_nearest(sparse, spec, grid, self.work_crs, self.out_crs)
            else:
                left, top, pixel, rows, cols = spec.x0, spec.y0 + spec.ny * spec.res, spec.res, spec.ny, spec.nx
                sparse = north_up(sparse, spec.ny)
            about = {
                "transform": self.tf.name, "cap_km": self.cap, "res_m": self.res, "scale": self.scale, "units": "percentile", "decode": DECODING, "nodata": -32768,
                "crs": f"EPSG:{self.out_crs}", "left": left, "top": top, "pixel": pixel, "rows": rows, "cols": cols,
            }
            tags = {k: about[k] for k in ("transform", "cap_km", "res_m", "scale", "units")}
            files = {f"{band}_dn": (f"{self.out}/{band}.tif", tags | {"decode": DECODING[band]}, factor) for band, factor in (("value", self.scale), ("support", None))}
            return sinks.write_tiled(sparse, f"{self.out}/raster", about, self.compress, files if self.geotiff else {}, rows, cols, left, top, pixel, self.out_crs)
        finally:
            self.points.unpersist()


def run(spark: SparkSession, input: str, **options) -> str:
    """A surface in one call; see Pipeline for the options."""
    return Pipeline(spark, input, **options).run()
