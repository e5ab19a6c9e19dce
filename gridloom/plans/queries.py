"""The registered queries of the surface operators, each with its SQL."""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import quantise
from gridloom.functions.crs import project, to_equal_area, to_mercator
from gridloom.functions.transforms import PercentileTransform, make_transform, quantiles, rising, transforms
from gridloom.operators import calibrate, cells, raster
from gridloom.operators.surface import pull_push_frames, surface
from gridloom.plans import oracle, views
from gridloom.plans.pipeline import Pipeline
from gridloom.plans.views import with_views
from gridloom.sources import sinks
from gridloom.sources.points import exact_sample, extent, finite, read_table
from gridloom.spec import GridSpec, pad_to_pyramid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Added before rounding on both sides, so that exact halves don't fall either way by the order of sums.
NUDGE = 3.3e-7


def r4(*columns: str) -> list:
    return [F.round(F.col(c) + NUDGE, 4).alias(c) for c in columns]


def evt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.bin_points(views.events(spark, sf_dir), 0.0, 0.0, 1e3)


def spec_of(table: DataFrame, res: float, levels: int, cap_m: float = 0.0, **more) -> GridSpec:
    """Grid from (0, 0) to the last occupied cell."""
    r = table.agg(F.max("ix"), F.max("iy")).first()
    return GridSpec(0.0, 0.0, res, r[0] + 1, r[1] + 1, levels, cap_m, **more)


EVT = f"cells AS ({oracle.cells('p_evt', 1e3)})"


@query(with_views("SELECT id, x, y, v FROM p_dirty WHERE v IS NOT NULL AND isfinite(v)", "p_evt", "p_dirty"))
def q01_finite_filter(spark, sf_dir):
    return finite(views.dirty_events(spark, sf_dir), "x", "y", "v").select("id", "x", "y", "v")


@query(with_views(f"SELECT ix, iy, round(s + 3.3e-7, 4) AS s, c FROM ({oracle.cells('p_li', 1e3)})", "p_li"))
def q02_bin_points(spark, sf_dir):
    return cells.bin_points(views.lineitem(spark, sf_dir), 0.0, 0.0, 1e3).select("ix", "iy", *r4("s"), "c")


@query(
    with_views(
        f", c AS ({oracle.cells('p_li', 1e3)}) SELECT k.i::INT AS level, ix // (1 << k.i) AS ix, iy // (1 << k.i) AS iy, round(sum(s), 2) AS s, sum(c)::BIGINT AS c FROM c, (SELECT unnest(range(0, 5)) AS i) k GROUP BY ALL", "p_li"
    )
)
def q03_pyramid_levels(spark, sf_dir):
    c = cells.bin_points(views.lineitem(spark, sf_dir), 0.0, 0.0, 1e3)
    return cells.pyramid(c, 4).select("level", "ix", "iy", F.round("s", 2).alias("s"), "c")


DENSE1 = f"{EVT}, c1 AS (SELECT ix // 2 AS ix, iy // 2 AS iy, sum(s) AS s, sum(c) AS c FROM cells GROUP BY ALL), d AS (SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny FROM c1), g AS (SELECT a.i AS ix, b.i AS iy, coalesce(s / c, 0) AS val FROM (SELECT unnest(range(0, nx)) AS i FROM d) a, (SELECT unnest(range(0, ny)) AS i FROM d) b LEFT JOIN c1 ON ix = a.i AND iy = b.i)"


def dense_level1(spark, sf_dir) -> DataFrame:
    from gridloom.operators.surface import dense_grid

    c1 = cells.downsample_sum(evt_cells(spark, sf_dir))
    r = c1.agg(F.max("ix"), F.max("iy")).first()
    return dense_grid(c1, r[0] + 1, r[1] + 1).join(c1, ["ix", "iy"], "left").select("ix", "iy", F.coalesce(F.col("s") / F.col("c"), F.lit(0.0)).alias("val"))


@query(with_views(f", {DENSE1} SELECT 2 * ix + a.i AS ix, 2 * iy + b.i AS iy, round(val + 3.3e-7, 4) AS val FROM g, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(i)", "p_evt"))
def q04_upsample_nearest(spark, sf_dir):
    return cells.upsample_nearest(dense_level1(spark, sf_dir)).select("ix", "iy", *r4("val"))


@query(
    with_views(
        f""", {DENSE1}, kids AS (SELECT 2 * ix + a.i AS ix, 2 * iy + b.i AS iy, ix AS px, iy AS py,
          greatest(0, least(nx - 1, ix + 2 * a.i - 1)) AS qx, greatest(0, least(ny - 1, iy + 2 * b.i - 1)) AS qy
          FROM g, d, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(i))
        SELECT k.ix, k.iy, round((9 * a.val + 3 * b.val + 3 * c.val + e.val) / 16 + 3.3e-7, 4) AS val FROM kids k
        JOIN g a ON a.ix = px AND a.iy = py JOIN g b ON b.ix = qx AND b.iy = py JOIN g c ON c.ix = px AND c.iy = qy JOIN g e ON e.ix = qx AND e.iy = qy""",
        "p_evt",
    )
)
def q05_upsample_bilinear(spark, sf_dir):
    return cells.upsample_bilinear(dense_level1(spark, sf_dir), ["val"]).select("ix", "iy", *r4("val"))


def pushed(spark, sf_dir, cap_m: float = 0.0, levels: int = 3, mask: bool = False, block: int = 256) -> DataFrame:
    c = evt_cells(spark, sf_dir)
    return surface(c, spec_of(c, 1e3, levels, cap_m, block=block), mask=mask)


PUSH3 = f", {EVT}, {oracle.pull_push('cells', 1e3, 3)}"


@query(with_views(f"{PUSH3} SELECT ix, iy, round(val + 3.3e-7, 4) AS val FROM push", "p_evt"))
def q06_pull_push_value(spark, sf_dir):
    return pushed(spark, sf_dir).select("ix", "iy", *r4("val"))


@query(with_views(f"{PUSH3} SELECT ix, iy, round(sup + 3.3e-7, 4) AS sup FROM push", "p_evt"))
def q07_pull_push_support(spark, sf_dir):
    return pushed(spark, sf_dir).select("ix", "iy", *r4("sup"))


@query(with_views(f", cells AS ({oracle.cells('p_li', 1e4)}), {oracle.pull_push('cells', 1e4, 2, 5.0, True)} SELECT ix, iy, round(val + 3.3e-7, 4) AS val, round(sup + 3.3e-7, 4) AS sup FROM push", "p_li"))
def q08_pull_push_saturation(spark, sf_dir):
    c = cells.bin_points(views.lineitem(spark, sf_dir), 0.0, 0.0, 1e4)
    return surface(c, spec_of(c, 1e4, 2, saturation=5.0), upsample="nearest", mask=False).select("ix", "iy", *r4("val", "sup"))


EMB = f"cells AS ({oracle.cells('p_emb', 1e3, 'min')}), d AS (SELECT max(ix) AS mx, max(iy) AS my FROM cells), g AS (SELECT a.i AS ix, b.i AS iy FROM (SELECT unnest(range(0, mx + 1)) AS i FROM d) a, (SELECT unnest(range(0, my + 1)) AS i FROM d) b)"


def emb_cells(spark, sf_dir) -> tuple[DataFrame, tuple[int, int]]:
    p = views.embeddings(spark, sf_dir)
    x0, y0 = p.agg(F.min("x"), F.min("y")).first()
    c = cells.bin_points(p, x0, y0, 1e3)
    r = c.agg(F.max("ix"), F.max("iy")).first()
    return c, (r[0] + 1, r[1] + 1)


@query(with_views(f", {EMB} SELECT g.ix, g.iy, sum(c)::BIGINT AS n FROM g JOIN cells c ON abs(c.ix - g.ix) <= 2 AND abs(c.iy - g.iy) <= 2 GROUP BY ALL", "p_emb"))
def q09_box_count(spark, sf_dir):
    c, shape = emb_cells(spark, sf_dir)
    return cells.box_count(c, 2, shape)


@query(with_views(f", {EMB} SELECT g.ix, g.iy, EXISTS (SELECT 1 FROM cells c WHERE abs(c.ix - g.ix) <= 3 AND abs(c.iy - g.iy) <= 3) AS near FROM g", "p_emb"))
def q10_fill_mask(spark, sf_dir):
    from gridloom.operators.surface import dense_grid

    c, shape = emb_cells(spark, sf_dir)
    spec = GridSpec(0.0, 0.0, 1e3, *shape, levels=2, cap_m=3e3, block=256)
    near = surface(c, spec).select("ix", "iy", F.lit(True).alias("near"))
    return dense_grid(c, *shape).join(near, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("near", F.lit(False)).alias("near"))


@query(with_views(f"{PUSH3} SELECT ix, iy, round_even(round(val * 10, 9), 0)::SMALLINT AS value_dn FROM push", "p_evt"))
def q11_quantise_value(spark, sf_dir):
    return pushed(spark, sf_dir).select("ix", "iy", quantise.encode_value(F.col("val"), 10).alias("value_dn"))


@query(with_views(f"{PUSH3} SELECT ix, iy, least(greatest(round_even(round(log2(greatest(sup / 1e3, 1e-3)) * 8, 9), 0), -32000), 32000)::SMALLINT AS support_dn FROM push", "p_evt"))
def q12_quantise_support(spark, sf_dir):
    return pushed(spark, sf_dir).select("ix", "iy", quantise.encode_support(F.col("sup")).alias("support_dn"))


@query(with_views(f", {oracle.knots('p_li', 101)} SELECT i::INT AS i, round(q + 3.3e-7, 4) AS q FROM k", "p_li"))
def q13_quantile_lut(spark, sf_dir):
    q = quantiles(views.lineitem(spark, sf_dir), "v", 101)
    import numpy as np

    rows = [(i, float(x)) for i, x in enumerate(np.maximum.accumulate(q))]
    return spark.createDataFrame(rows, "i int, q double").select("i", F.round(F.col("q") + NUDGE, 4).alias("q"))


def percentile101(points: DataFrame) -> PercentileTransform:
    return PercentileTransform(rising(quantiles(points, "v", 101)))


@query(with_views(f", {oracle.knots('p_li', 101)}, r AS ({oracle.ranked('p_li', 'v', 't.x, t.y, t.v')}) SELECT x, y, v, round(pct, 4) AS pct FROM r", "p_li"))
def q14_percentile_fwd(spark, sf_dir):
    p = views.lineitem(spark, sf_dir)
    return p.select("x", "y", "v", F.round(percentile101(p).fwd(F.col("v")), 4).alias("pct"))


@query(with_views(f", {oracle.knots('p_li', 101)} SELECT t.p, round(a.q + (t.p - a.i) * (b.q - a.q) + 3.3e-7, 4) AS q FROM (SELECT unnest(range(0, 1000)) / 1e1 AS p) t JOIN k a ON a.i = floor(t.p) JOIN k b ON b.i = a.i + 1", "p_li"))
def q15_percentile_inv(spark, sf_dir):
    t = percentile101(views.lineitem(spark, sf_dir))
    return spark.range(1000).select((F.col("id") / F.lit(1e1)).alias("p")).select("p", F.round(t.inv(F.col("p")) + NUDGE, 4).alias("q"))


def _with_transform(name: str):
    def run(spark, sf_dir):
        t = next(t for t in transforms() if t.name == name)
        return views.lineitem(spark, sf_dir).select("x", "y", F.round(t.fwd(F.col("v")), 6).alias("tv"), F.round(t.inv(t.fwd(F.col("v"))), 4).alias("v"))

    return run


QUERIES["q16_transform_log10"] = _with_transform("log10")
ORACLE_SQL["q16_transform_log10"] = with_views("SELECT x, y, round(log10(v), 6) AS tv, round(pow(1e1, log10(v)), 4) AS v FROM p_li", "p_li")
QUERIES["q17_transform_sqrt"] = _with_transform("sqrt")
ORACLE_SQL["q17_transform_sqrt"] = with_views("SELECT x, y, round(sqrt(v), 6) AS tv, round(sqrt(v) * sqrt(v), 4) AS v FROM p_li", "p_li")


@query(with_views("SELECT name, ok FROM (SELECT min(v) AS m FROM p_geo), LATERAL (VALUES ('identity', true), ('log10', m > 0), ('sqrt', m >= 0), ('percentile', true)) t(name, ok)", "p_geo"))
def q18_transform_validity(spark, sf_dir):
    least = views.customers(spark, sf_dir).agg(F.min("v")).first()[0]
    return spark.createDataFrame([(t.name, bool(t.valid(least))) for t in transforms()], "name string, ok boolean")


@query(with_views("SELECT scale, round(icc, 6) + 0e0 AS icc FROM (" + " UNION ALL ".join(oracle.icc(s) for s in calibrate.SCALES) + ")", "p_li"))
def q19_icc(spark, sf_dir):
    p = views.lineitem(spark, sf_dir)
    x0, y0 = p.agg(F.min("x"), F.min("y")).first()
    return calibrate.icc_table(p, (x0, y0)).select("scale", (F.round("icc", 6) + 0.0).alias("icc"))


_TV = f", {oracle.knots('p_li', 1001)}, tv AS (SELECT x, y, v AS t0, log10(v) AS t1, sqrt(v) AS t2, pct AS t3 FROM ({oracle.ranked('p_li', 'v', 't.x, t.y, t.v')}))"
_SCORES = _TV + ", scores AS (" + " UNION ALL ".join(f"SELECT {k} AS ordinal, '{n}' AS name, * FROM ({oracle.icc(s, 'tv', f't{k}')})" for k, n in enumerate(("identity", "log10", "sqrt", "percentile")) for s in calibrate.SCALES) + ")"


@query(with_views(f"{_SCORES} SELECT name, scale, round(icc, 5) + 0e0 AS icc FROM scores", "p_li"))
def q20_transform_scores(spark, sf_dir):
    table, _ = calibrate.transform_scores(views.lineitem(spark, sf_dir))
    return table.select("name", "scale", (F.round("icc", 5) + 0.0).alias("icc"))


@query(with_views(f"{_SCORES} SELECT name, round(avg(icc), 5) + 0e0 AS score FROM scores GROUP BY ordinal, name ORDER BY round(avg(icc), 9) DESC, ordinal LIMIT 1", "p_li"))
def q21_choose_transform(spark, sf_dir):
    best, scores = calibrate.choose_transform(views.lineitem(spark, sf_dir))
    return spark.createDataFrame([(best.name, scores[0][1])], "name string, score double").select("name", (F.round("score", 5) + 0.0).alias("score"))


def _blocks(block: float) -> str:
    return (
        f"o AS (SELECT min(x) AS x0, min(y) AS y0 FROM p_field), b AS (SELECT p_field.*, floor((x - x0) / {block:e})::BIGINT AS bx, floor((y - y0) / {block:e})::BIGINT AS bj, floor((x - x0) / 1e3)::BIGINT AS ix, floor((y - y0) / 1e3)::BIGINT AS iy FROM p_field, o), "
        "folds AS (SELECT bx, bj, (ntile(4) OVER (ORDER BY (bx * 7919 + bj * 104729) % 1009, bx, bj) - 1)::INT AS fold FROM (SELECT DISTINCT bx, bj FROM b)), dealt AS (SELECT b.*, fold FROM b JOIN folds USING (bx, bj))"
    )


@query(with_views(f", {_blocks(2e4)} SELECT * FROM folds", "p_evt", "p_field"))
def q22_block_folds(spark, sf_dir):
    p = views.field(spark, sf_dir)
    return calibrate.block_folds(p, extent(p)[:2], 2e4, deal="hash").select("bx", F.col("by").alias("bj"), "fold")


def _fold(f: int) -> str:
    train = f"t{f} AS (SELECT ix, iy, sum(v) AS s, count(*) AS c FROM dealt WHERE fold <> {f} GROUP BY ALL)"
    return f"{train}, {oracle.pull_push(f't{f}', 1e3, 6, extent='dealt', at=f'_{f}')}"


def field_cv(spark, sf_dir, blocks_km: tuple[float, ...] = (20.0,)) -> calibrate.CrossValidation:
    return calibrate.CrossValidation(views.field(spark, sf_dir), 1000.0, 6, blocks_km, deal="hash", key="id")


@query(
    with_views(
        f", {_blocks(2e4)}, {', '.join(map(_fold, range(4)))} SELECT ix, iy, fold, count(*) AS n, round(any_value(val) + 3.3e-7, 4) AS pred, round(any_value(sup) / 1e3, 4) AS sup_km FROM ("
        + " UNION ALL ".join(f"SELECT d.ix, d.iy, d.fold, p.val, p.sup FROM dealt d JOIN push_{f} p USING (ix, iy) WHERE d.fold = {f}" for f in range(4))
        + ") GROUP BY ix, iy, fold",
        "p_evt",
        "p_field",
    )
)
def q23_cv_predict(spark, sf_dir):
    return field_cv(spark, sf_dir).cells.select("ix", "iy", "fold", "n", F.round(F.col("pred") + NUDGE, 4).alias("pred"), F.round("sup_km", 4).alias("sup_km"))


def _predicted(block: float) -> str:
    return f"{_blocks(block)}, {', '.join(map(_fold, range(4)))}, pred AS (" + " UNION ALL ".join(f"SELECT d.id, d.v AS act, p.val AS pred, p.sup / 1e3 AS sup_km FROM dealt d JOIN push_{f} p USING (ix, iy) WHERE d.fold = {f}" for f in range(4)) + ")"


_ERRORS = "e AS (SELECT *, (act - pred) ** 2 AS m, (act - (SELECT avg(act) FROM pred)) ** 2 AS b FROM pred)"
_PRED = f", {_predicted(2e4)}, {_ERRORS}"
_EDGES = ", ".join(f"({a:e}, {b:e})" for a, b in zip(calibrate.EDGES, calibrate.EDGES[1:], strict=False))


@query(with_views(f"{_PRED} SELECT lo_km, hi_km, count(*) AS n, round(1 - sqrt(avg(m)) / sqrt(avg(b)), 5) AS skill FROM e JOIN (VALUES {_EDGES}) t(lo_km, hi_km) ON sup_km >= lo_km AND sup_km < hi_km GROUP BY ALL HAVING count(*) >= 100", "p_evt", "p_field"))
def q24_cv_skill_bins(spark, sf_dir):
    return calibrate.skill_bins(field_cv(spark, sf_dir).cells, min_n=100).select("lo_km", "hi_km", "n", F.round("skill", 5).alias("skill"))


@query(with_views(f"{_PRED} SELECT 2e1 AS block_km, round(1 - sqrt(avg(m)) / sqrt(avg(b)), 5) AS skill FROM e", "p_evt", "p_field"))
def q25_cv_overall(spark, sf_dir):
    return calibrate.overall_skill(field_cv(spark, sf_dir).cells).select("block_km", F.round("skill", 5).alias("skill"))


CURVE = [(2.0, 50.0, 0.30), (2.0, 100.0, 0.01), (8.0, 50.0, 0.20), (32.0, 100.0, 0.10), (64.0, 200.0, 0.02)]


@query(
    "WITH c(hi, block, lo) AS (VALUES (2e0, 5e1, 3e-1), (2e0, 1e2, 1e-2), (8e0, 5e1, 2e-1), (3.2e1, 1e2, 1e-1), (6.4e1, 2e2, 2e-2)), "
    "f AS (SELECT hi, arg_min(lo, block) AS lo FROM c WHERE hi <= block / 2 GROUP BY hi) "
    "SELECT coalesce(max(hi), 2.5e1) AS cap_km FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.hi <= f.hi AND g.lo <= 5e-2)"
)
def q26_fill_cap(spark, sf_dir):
    return calibrate.cap_from_curve(spark.createDataFrame(CURVE, "hi_km double, block_km double, ci_lo double"))


@query(with_views(f"SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM (SELECT id, {oracle.EQUAL_AREA} FROM p_geo)", "p_geo"))
def q27_project_equal_area(spark, sf_dir):
    x, y = to_equal_area(F.col("lon"), F.col("lat"))
    return views.customers(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(with_views(f"SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM (SELECT id, {oracle.MERCATOR} FROM p_geo)", "p_geo"))
def q28_project_mercator(spark, sf_dir):
    x, y = to_mercator(F.col("lon"), F.col("lat"))
    return views.customers(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    with_views(
        f", {EVT}, d AS (SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny FROM cells) SELECT (ny - 1 - b.i)::INT AS row, a.i::INT AS col, coalesce(round_even(round(s / c, 9), 0), -32768)::SMALLINT AS value_dn FROM d, (SELECT unnest(range(0, nx)) AS i FROM d) a, (SELECT unnest(range(0, ny)) AS i FROM d) b LEFT JOIN cells ON ix = a.i AND iy = b.i",
        "p_evt",
    )
)
def q29_raster_orientation(spark, sf_dir):
    c = evt_cells(spark, sf_dir)
    r = c.agg(F.max("ix"), F.max("iy")).first()
    values = c.select("ix", "iy", quantise.encode_value(F.col("s") / F.col("c"), 1).alias("value_dn"))
    return raster.densify(raster.north_up(values, r[1] + 1), r[1] + 1, r[0] + 1)


@query(
    with_views(
        f"{PUSH3}, q AS (SELECT ix, iy, round_even(round(val * 10, 9), 0)::SMALLINT AS a, least(greatest(round_even(round(log2(greatest(sup / 1e3, 1e-3)) * 8, 9), 0), -32000), 32000)::SMALLINT AS b FROM push) SELECT ix, iy, round(a / 1e1, 4) AS value, round(pow(2e0, b / 8e0), 4) AS support_km FROM q",
        "p_evt",
    )
)
def q30_decode(spark, sf_dir):
    dn = pushed(spark, sf_dir).select("ix", "iy", quantise.encode_value(F.col("val"), 10).alias("a"), quantise.encode_support(F.col("sup")).alias("b"))
    return dn.select("ix", "iy", F.round(quantise.decode_value(F.col("a"), 10), 4).alias("value"), F.round(quantise.decode_support(F.col("b")), 4).alias("support_km"))


GEO = GridSpec(-1.75e7, -7.4e6, 5e5, 70, 30, 1, 0.0)
GEO_OUT = (-2e7, 1.8e7, 1e6, 36, 40)


@query(
    with_views(
        f", w AS (SELECT {oracle.EQUAL_AREA}, v FROM p_geo), r AS (SELECT floor((x + 1.75e7) / 5e5)::BIGINT AS ix, floor((y + 7.4e6) / 5e5)::BIGINT AS iy, count(*) AS n FROM w GROUP BY ALL), "
        f"px AS (SELECT a.i::INT AS row, b.i::INT AS col, -2e7 + (b.i + 5e-1) * 1e6 AS X, 1.8e7 - (a.i + 5e-1) * 1e6 AS Y FROM range(36) a(i), range(40) b(i)), "
        f"pos AS ({oracle.equal_area_of_mercator('px')}) SELECT row, col, n FROM pos JOIN r ON ix = floor((wx + 1.75e7) / 5e5) AND iy = floor((wy + 7.4e6) / 5e5)",
        "p_geo",
    )
)
def q31_reproject_nearest(spark, sf_dir):
    g = views.customers(spark, sf_dir)
    x, y = to_equal_area(F.col("lon"), F.col("lat"))
    c = cells.bin_points(g.select(x.alias("x"), y.alias("y"), "v"), GEO.x0, GEO.y0, GEO.res)
    return raster.reproject_nearest(c.select("ix", "iy", F.col("c").alias("n")), GEO, GEO_OUT)


@query(
    with_views(
        f", c AS ({oracle.cells('p_li', 1e3)}), d AS (SELECT max(ix) // 64 AS mx, max(iy) // 64 AS my FROM c) SELECT a.i::INT AS tx, b.i::INT AS ty, count(*) AS n_cells, sum(c)::BIGINT AS n_points "
        "FROM (SELECT unnest(range(0, mx + 1)) AS i FROM d) a, (SELECT unnest(range(0, my + 1)) AS i FROM d) b JOIN c ON ix >= 64 * a.i - 16 AND ix < 64 * a.i + 80 AND iy >= 64 * b.i - 16 AND iy < 64 * b.i + 80 GROUP BY ALL",
        "p_li",
    )
)
def q32_tile_neighbourhood(spark, sf_dir):
    c = cells.bin_points(views.lineitem(spark, sf_dir), 0.0, 0.0, 1e3)
    r = c.agg(F.max("ix"), F.max("iy")).first()
    return cells.to_tiles(c, 64, 16, (r[0] + 1, r[1] + 1)).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("c").alias("n_points"))


@query(
    with_views(
        f", {EVT}, {oracle.pull_push('cells', 1e3, 2)}, {oracle.near(3)}, {oracle.knots('p_evt', 101)}, m AS (SELECT push.* FROM push JOIN near USING (ix, iy)), r AS ({oracle.ranked('m', 'val', 't.ix, t.iy, t.sup')}) "
        "SELECT ix, iy, round_even(round(pct * 100, 9), 0)::SMALLINT AS value_dn, least(greatest(round_even(round(log2(greatest(sup / 1e3, 1e-3)) * 8, 9), 0), -32000), 32000)::SMALLINT AS support_dn FROM r",
        "p_evt",
    )
)
def q33_full_surface(spark, sf_dir):
    p = views.events(spark, sf_dir)
    t = percentile101(p)
    out = pushed(spark, sf_dir, cap_m=3e3, levels=2, mask=True)
    return raster.quantised(out.select("ix", "iy", t.fwd(F.col("val")).alias("pct"), "sup"), 100)


def _bootstrap(reps: int) -> str:
    """CTE bounds (hi_km, ci_lo) over e, with each point's weight from its id and the replicate's number."""
    draws = f"r0 AS (SELECT e.*, t.lo_km, t.hi_km, rep, ((id % {calibrate.MODULUS}) * {calibrate.FACTOR} + (rep + 1) * {calibrate.STRIDE}) % {calibrate.MODULUS} AS x FROM e JOIN (VALUES {_EDGES}) t(lo_km, hi_km) ON sup_km >= lo_km AND sup_km < hi_km, range({reps}) k(rep))"
    for k in range(calibrate.ROUNDS):
        draws += f", r{k + 1} AS (SELECT * EXCLUDE (x), (x * x + {calibrate.FACTOR}) % {calibrate.MODULUS} AS x FROM r{k})"
    weight = " + ".join(f"(x >= {t})::INT" for t in calibrate.POISSON)
    return (
        f"{draws}, w AS (SELECT *, {weight} AS w FROM r{calibrate.ROUNDS}), s AS (SELECT hi_km, rep, count(*) AS n, 1 - sqrt(sum(w * m)) / sqrt(sum(w * b)) AS skill FROM w GROUP BY ALL), "
        "bounds AS (SELECT hi_km, quantile_cont(skill, 0.05) AS ci_lo, quantile_cont(skill, 0.95) AS ci_hi FROM s GROUP BY hi_km HAVING any_value(n) >= 100)"
    )


@query(with_views(f"{_PRED}, {_bootstrap(200)} SELECT 2e1 AS block_km, hi_km, round(ci_lo, 5) AS ci_lo, round(ci_hi, 5) AS ci_hi FROM bounds", "p_evt", "p_field"))
def q34_bootstrap_ci(spark, sf_dir):
    cv = field_cv(spark, sf_dir)
    ci = calibrate.bootstrap_ci(cv.by_point(), min_n=100, cells=cv.cells)
    return ci.select("block_km", "hi_km", F.round("ci_lo", 5).alias("ci_lo"), F.round("ci_hi", 5).alias("ci_hi"))


@query(with_views(f"{PUSH3} SELECT ix, iy, round(val + 3.3e-7, 4) AS val, round(sup + 3.3e-7, 4) AS sup FROM push", "p_evt"))
def q35_pull_push_frames(spark, sf_dir):
    """The same surface by windows and joins only."""
    c = evt_cells(spark, sf_dir)
    r = c.agg(F.max("ix"), F.max("iy")).first()
    shape = pad_to_pyramid(r[0] + 1, 3), pad_to_pyramid(r[1] + 1, 3)
    return pull_push_frames(c, shape, 1e3, 3).where((F.col("ix") <= r[0]) & (F.col("iy") <= r[1])).select("ix", "iy", *r4("val", "sup"))


# -- calibration as a whole ---------------------------------------------------------------
CV_BLOCKS = (10.0, 20.0, 40.0)


def _curve(km: float) -> str:
    """Rows (block_km, hi_km, ci_lo) of one block size, as a subquery."""
    return f"SELECT {km:e} AS block_km, hi_km, ci_lo FROM (WITH {_predicted(km * 1e3)}, {_ERRORS}, {_bootstrap(200)} SELECT * FROM bounds)"


_RULE = "f AS (SELECT hi_km AS hi, arg_min(ci_lo, block_km) AS lo FROM c WHERE hi_km <= block_km / 2 GROUP BY hi_km) SELECT coalesce(max(hi), 2.5e1) AS cap_km FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.hi <= f.hi AND g.lo <= 5e-2)"


@query(with_views(f", c AS ({' UNION ALL '.join(map(_curve, CV_BLOCKS))}), {_RULE}", "p_evt", "p_field"))
def q36_calibrate_fill_cap(spark, sf_dir):
    """Folds, predictions, bootstrap bounds and the cap rule, from points to the cap."""
    cap, _ = calibrate.calibrate_fill_cap(views.field(spark, sf_dir), CV_BLOCKS, levels=6, min_n=100, deal="hash", key="id")
    return spark.createDataFrame([(cap,)], "cap_km double")


@query(with_views(f"{_PRED}, {_bootstrap(200)}, t AS (SELECT hi_km, count(*) // 200 AS n, 1 - sqrt(avg(m)) / sqrt(avg(b)) AS skill FROM r0 GROUP BY hi_km) SELECT hi_km, n, round(skill, 5) AS skill, round(ci_lo, 5) AS ci_lo FROM t JOIN bounds USING (hi_km)", "p_evt", "p_field"))
def q37_blocked_cv_skill(spark, sf_dir):
    _, rows = calibrate.blocked_cv_skill(views.field(spark, sf_dir), levels=6, block_km=20.0, min_n=100, deal="hash", key="id")
    table = spark.createDataFrame([(r["hi_km"], r["n"], r["skill"], r["ci_lo"]) for r in rows], "hi_km double, n long, skill double, ci_lo double")
    return table.select("hi_km", "n", F.round("skill", 5).alias("skill"), F.round("ci_lo", 5).alias("ci_lo"))


@query("SELECT 0::BIGINT AS held_out, 0::BIGINT AS bins")
def q38_folds_without_training(spark, sf_dir):
    """One block makes one fold, which has nothing to learn from, and is skipped."""
    cv = calibrate.CrossValidation(views.field(spark, sf_dir), 1000.0, 3, [1e6], deal="hash", key="id")
    return spark.createDataFrame([(cv.points().count(), calibrate.skill_bins(cv.cells).count())], "held_out long, bins long")


@query(with_views("SELECT least(500, (SELECT count(*) FROM p_geo)) AS n, true AS rows_of_the_table, true AS distinct_rows", "p_geo"))
def q39_exact_sample(spark, sf_dir):
    p = views.customers(spark, sf_dir)
    s = exact_sample(p, 500, p.count()).persist()
    out = [(s.count(), s.join(p, "id", "left_anti").isEmpty(), s.select("id").distinct().count() == s.count())]
    s.unpersist()
    return spark.createDataFrame(out, "n long, rows_of_the_table boolean, distinct_rows boolean")


# -- sources and sinks -----------------------------------------------------------------------
def scratch(spark: SparkSession, name: str) -> str:
    """A folder for what a query writes and reads again: the cluster's shared one, or a temporary one where the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}"
    return f"{where}/gridloom-{uuid.uuid4().hex}/{name}"


GEO_COLUMNS = ("v", "lon", "lat")


@query(with_views("SELECT v, lon, lat FROM p_geo", "p_geo"))
def q40_csv_scan(spark, sf_dir):
    """Three columns of a CSV file with more of them, cast to doubles."""
    path = scratch(spark, "points.csv")
    views.customers(spark, sf_dir).withColumn("note", F.lit("x")).write.option("header", True).csv(path)
    return read_table(spark, path, *GEO_COLUMNS)


@query(with_views("SELECT v, lon, lat FROM p_geo", "p_geo"))
def q41_parquet_scan(spark, sf_dir):
    path = scratch(spark, "points.parquet")
    views.customers(spark, sf_dir).withColumn("note", F.lit("x")).write.parquet(path)
    return read_table(spark, path, *GEO_COLUMNS)


@query("SELECT * FROM (VALUES ('cap_km', '16.0'), ('cv', '{\"20.0\": {\"overall_skill\": null}}'), ('transform', '\"log10\"')) t(name, value)")
def q42_calibration_document(spark, sf_dir):
    """A calibration document written and read back; what JSON has no number for is null."""
    path = scratch(spark, "calibration.json")
    sinks.write_json(spark, {"transform": "log10", "cap_km": 16.0, "cv": {20.0: {"overall_skill": float("nan")}}}, path)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sinks.read_json(spark, path).items()], "name string, value string")


def counts_raster(spark, sf_dir) -> tuple[DataFrame, int, int]:
    c = evt_cells(spark, sf_dir)
    r = c.agg(F.max("ix"), F.max("iy")).first()
    return raster.north_up(c.select("ix", "iy", F.col("c").cast("short").alias("dn")), r[1] + 1), r[1] + 1, r[0] + 1


_COUNTS = f", {EVT}, d AS (SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny FROM cells)"


@query(with_views(f"{_COUNTS} SELECT (ny - 1 - iy)::INT AS row, ix::INT AS col, c::SMALLINT AS dn FROM cells, d", "p_evt"))
def q43_raster_replaced(spark, sf_dir):
    """A raster takes the place of another one; a write that fails leaves it there."""
    out, rows, cols = counts_raster(spark, sf_dir)
    path = scratch(spark, "raster")
    sinks.write_raster(out.limit(3), path, {"rows": 1})
    sinks.write_raster(out, path, {"rows": rows})
    try:
        sinks.write_raster(out.select("row", "col", F.raise_error(F.lit("planned")).cast("short").alias("dn")), path, {"rows": 0})
    except Exception as e:  # noqa: BLE001
        if "planned" not in str(e):
            raise
    if sinks.read_json(spark, f"{path}.json") != {"rows": rows}:
        raise AssertionError("the metadata of the raster that stayed are lost")
    return spark.read.parquet(path)


@query(with_views(f"{_COUNTS} SELECT (ny - 1 - b.i)::INT AS row, a.i::INT AS col, coalesce(c, -32768)::SMALLINT AS dn FROM d, (SELECT unnest(range(0, nx)) AS i FROM d) a, (SELECT unnest(range(0, ny)) AS i FROM d) b LEFT JOIN cells ON ix = a.i AND iy = b.i", "p_evt"))
def q44_geotiff(spark, sf_dir):
    """All pixels of a tiled GeoTIFF, written and read back."""
    out, rows, cols = counts_raster(spark, sf_dir)
    path = scratch(spark, "counts.tif")
    sinks.write_geotiff(out, "dn", rows, cols, 0.0, rows * 1e3, 1e3, 6933, path, tile=64)
    return sinks.read_geotiff(spark, path)[0]


@query(
    with_views(
        f", w AS (SELECT {oracle.EQUAL_AREA}, v FROM p_geo), cells AS ({oracle.cells('w', 5e5, 'min')}), {oracle.pull_push('cells', 5e5, 1)}, {oracle.near(2)}, {oracle.knots('w', 1001)}, m AS (SELECT push.* FROM push JOIN near USING (ix, iy)), r AS ({oracle.ranked('m', 'val', 't.ix, t.iy, t.sup')}), "
        "d AS (SELECT max(iy) AS my FROM cells) SELECT (my - iy)::INT AS row, ix::INT AS col, round_even(round(pct * 100, 9), 0)::SMALLINT AS value_dn, least(greatest(round_even(round(log2(greatest(sup / 1e3, 1e-3)) * 8, 9), 0), -32000), 32000)::SMALLINT AS support_dn FROM r, d",
        "p_geo",
    )
)
def q45_command_line(spark, sf_dir):
    """The command line from a CSV file to the raster, the value and support bands as it writes them."""
    from gridloom.__main__ import main

    path = scratch(spark, "points.csv")
    views.customers(spark, sf_dir).write.option("header", True).csv(path)
    with contextlib.redirect_stdout(io.StringIO()):
        out = main([path, "-o", scratch(spark, "out"), "--value-col", "v", "--lng-col", "lon", "--lat-col", "lat", "--res", "500000", "--cap-km", "1000", "--out-crs", "6933", "--skip-calibration"])
    return spark.read.parquet(out)


@query("SELECT * FROM (VALUES ('cap_km', '1000.0'), ('crs', '\"EPSG:6933\"'), ('nodata', '-32768'), ('pixel', '500000.0'), ('res_m', '500000.0'), ('scale', '12.5'), ('transform', '\"identity\"'), ('units', '\"percentile\"')) t(name, value)")
def q46_raster_metadata(spark, sf_dir):
    """What a run says about its raster, and the same from the note in its GeoTIFF."""
    path, folder = scratch(spark, "points.parquet"), scratch(spark, "out")
    views.customers(spark, sf_dir).write.parquet(path)
    out = Pipeline(spark, path, out=folder, value_col="v", lng_col="lon", lat_col="lat", res=5e5, cap_km=1000.0, out_crs=6933, scale=12.5, skip_calibration=True).run()
    about = sinks.read_json(spark, f"{out}.json")
    _, place = sinks.read_geotiff(spark, f"{folder}/value.tif")
    same = all(place["note"][k] == about[k] for k in ("transform", "cap_km", "res_m", "scale", "units")) and (place["rows"], place["cols"], place["pixel"]) == (about["rows"], about["cols"], about["pixel"])
    if not same:
        raise AssertionError("the note of the GeoTIFF differs from the metadata")
    names = ("cap_km", "crs", "nodata", "pixel", "res_m", "scale", "transform", "units")
    return spark.createDataFrame([(k, json.dumps(about[k])) for k in names], "name string, value string")


# -- limits ------------------------------------------------------------------------------------
@query(
    "SELECT * FROM (VALUES ('a cell outside of the grid', 'indices out of range'), ('a grid that levels do not divide', 'divisible by 2 ** levels'), ('a scale beyond 16 bits', 'exceeds int16 max'), ('a halo wider than a tile', 'exceeds block size'), "
    "('no valid points', 'No valid points'), ('an unknown transform', 'Unknown transform'), ('a value that is no number', 'CAST_INVALID_INPUT')) t(what, says)"
)
def q47_refusals(spark, sf_dir):
    """What is refused, and the words that say so."""
    p = views.events(spark, sf_dir)
    text = scratch(spark, "bad.csv")
    spark.createDataFrame([("x", "0", "0")], "value string, longitude string, latitude string").coalesce(1).write.option("header", True).csv(text)
    tries = (
        ("a cell outside of the grid", "indices out of range", lambda: cells.bin_points(p, 0.0, 0.0, 1e3, shape=(1, 1)).collect()),
        ("a grid that levels do not divide", "divisible by 2 ** levels", lambda: pull_push_frames(evt_cells(spark, sf_dir), (7, 7), 1e3, 2)),
        ("a scale beyond 16 bits", "exceeds int16 max", lambda: Pipeline(spark, text, scale=327.68)),
        ("a halo wider than a tile", "exceeds block size", lambda: GridSpec(0.0, 0.0, 500.0, 10, 10, 1, 1000.0, block=3)),
        ("no valid points", "No valid points", lambda: extent(p.where("id < 0"))),
        ("an unknown transform", "Unknown transform", lambda: make_transform({"name": "cubic"})),
        ("a value that is no number", "CAST_INVALID_INPUT", lambda: read_table(spark, text).collect()),
    )
    rows = []
    for what, says, attempt in tries:
        try:
            attempt()
        except Exception as e:  # noqa: BLE001
            rows.append((what, says if says in str(e) else str(e)))
        else:
            rows.append((what, "nothing"))
    return spark.createDataFrame(rows, "what string, says string")


@query(with_views("SELECT id, round(lon, 6) AS x, round(lat, 6) AS y, v FROM p_geo", "p_geo"))
def q48_projections_and_back(spark, sf_dir):
    """Degrees to equal-area metres, to Mercator and back to degrees."""
    g = views.customers(spark, sf_dir)
    x, y = project(F.col("lon"), F.col("lat"), 4326, 6933)
    a = g.select("id", "v", x.alias("x"), y.alias("y"))
    x, y = project(F.col("x"), F.col("y"), 6933, 3857)
    b = a.select("id", "v", x.alias("x"), y.alias("y"))
    x, y = project(F.col("x"), F.col("y"), 3857, 4326)
    return b.select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), "v")
