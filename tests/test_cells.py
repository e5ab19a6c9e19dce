import numpy as np
import pytest
from gridloom import bin_points, box_count, downsample_sum, pad_to_pyramid, upsample_bilinear, upsample_nearest
from gridloom.operators.cells import pyramid, to_tiles


def frame(spark, a, name="val"):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.ndindex(a.shape)], f"ix long, iy long, {name} double")


def dense(df, shape, name="val"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["ix"], r["iy"]] = r[name]
    return out


def cell_frame(spark, c, s=None):
    s = c if s is None else s
    return spark.createDataFrame([(int(i), int(j), float(s[i, j]), int(c[i, j])) for i, j in np.ndindex(c.shape) if c[i, j]], "ix long, iy long, s double, c long")


def test_downsample_sums_blocks(spark):
    a = np.arange(1, 17).reshape(4, 4)
    assert dense(downsample_sum(cell_frame(spark, a)), (2, 2), "s").tolist() == [[14, 22], [46, 54]]


def test_upsample_nearest_repeats(spark):
    got = dense(upsample_nearest(frame(spark, np.array([[1.0, 2], [3, 4]]))), (4, 4))
    assert got.tolist() == [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]


def test_upsample_bilinear_is_between_and_keeps_constants(spark):
    a = np.array([[0.0, 100], [0, 100]])
    got = dense(upsample_bilinear(frame(spark, a), ["val"]), (4, 4))
    assert got.min() >= 0 and got.max() <= 100 and got[0].tolist() == [0, 25, 75, 100]
    flat = dense(upsample_bilinear(frame(spark, np.full((3, 2), 7.0)), ["val"]), (6, 4))
    assert (flat == 7).all()


@pytest.mark.parametrize("shape", [(1, 3), (3, 1), (1, 1)])
def test_upsample_of_single_rows(spark, shape):
    got = dense(upsample_bilinear(frame(spark, np.full(shape, 5.0)), ["val"]), (2 * shape[0], 2 * shape[1]))
    assert (got == 5).all()


def test_bin_points(spark):
    p = spark.createDataFrame([(0.5, 0.5, 10.0), (0.5, 0.9, 20.0), (1.5, 1.5, 30.0), (2.5, 0.5, 40.0)], "x double, y double, v double")
    got = {(r.ix, r.iy): (r.s, r.c) for r in bin_points(p, 0, 0, 1.0, shape=(3, 2)).collect()}
    assert got == {(0, 0): (30.0, 2), (1, 1): (30.0, 1), (2, 0): (40.0, 1)}


def test_bin_points_outside_raises(spark):
    p = spark.createDataFrame([(-0.5, 0.5, 10.0)], "x double, y double, v double")
    with pytest.raises(Exception, match="out of range"):
        bin_points(p, 0, 0, 1.0, shape=(3, 2)).collect()


def test_box_count(spark):
    c = np.zeros((5, 5), int)
    c[2, 2] = 10
    got = dense(box_count(cell_frame(spark, c), 1, (5, 5)), (5, 5), "n")
    assert (got[1:4, 1:4] == 10).all() and got.sum() == 90


def test_box_count_matches_brute_force_at_the_border(spark):
    c = np.random.default_rng(0).poisson(0.3, (9, 7))
    want = np.array([[c[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3].sum() for j in range(7)] for i in range(9)])
    assert (dense(box_count(cell_frame(spark, c), 2, (9, 7)), (9, 7), "n") == want).all()


def test_pyramid_conserves_sums(spark):
    c = np.random.default_rng(1).poisson(1.0, (8, 8))
    levels = pyramid(cell_frame(spark, c, c * 2.5), 3).groupBy("level").sum("s", "c").collect()
    assert len(levels) == 4 and {(r["sum(s)"], r["sum(c)"]) for r in levels} == {(c.sum() * 2.5, c.sum())}


@pytest.mark.parametrize("levels", [0, 2, 7])
def test_pyramid_sums_every_level_where_its_cells_are(spark, levels):
    """Values of all levels, deeper than one step too; cells given twice add up; levels are not shuffled."""
    c = np.random.default_rng(2).poisson(0.2, (150, 40))
    df = cell_frame(spark, c, c * 0.5)
    got = {(r.level, r.ix, r.iy): (r.s, r.c) for r in pyramid(df.unionAll(df), levels).collect()}
    want = {}
    for k in range(levels + 1):
        for i, j in zip(*map(lambda a: a.tolist(), np.nonzero(c)), strict=True):
            at = (k, i >> k, j >> k)
            s, n = want.get(at, (0.0, 0))
            want[at] = (s + float(c[i, j]), n + 2 * int(c[i, j]))
    assert got == want
    plan = pyramid(df, min(levels, 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_tiles_hold_their_halo(spark):
    c = np.ones((20, 12), int)
    got = to_tiles(cell_frame(spark, c), 8, 3, (20, 12)).groupBy("tx", "ty").count().collect()
    want = {(a, b): (min(20, 8 * a + 11) - max(0, 8 * a - 3)) * (min(12, 8 * b + 11) - max(0, 8 * b - 3)) for a in range(3) for b in range(2)}
    assert {(r.tx, r.ty): r["count"] for r in got} == want


@pytest.mark.parametrize(("n", "levels", "want"), [(10, 3, 16), (16, 3, 16), (17, 3, 24), (1, 2, 4)])
def test_padding(n, levels, want):
    assert pad_to_pyramid(n, levels) == want
