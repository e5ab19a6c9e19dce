import numpy as np
import pyarrow as pa
import pytest
from gridloom import GridSpec, pull_push_frames, surface
from gridloom.operators.surface import box_sum, solve, up_bilinear
from tests.test_cells import cell_frame, dense


def random_cells(shape, seed=0, rate=0.1):
    r = np.random.default_rng(seed)
    c = r.poisson(rate, shape)
    return c, np.where(c > 0, c * r.uniform(10, 100, shape), 0.0)


def brute_up(a):
    n, m = a.shape
    at = lambda i, k: min(max(i // 2 + (1 if i % 2 else -1), 0), k - 1)
    return np.array([[(9 * a[i // 2, j // 2] + 3 * a[at(i, n), j // 2] + 3 * a[i // 2, at(j, m)] + a[at(i, n), at(j, m)]) / 16 for j in range(2 * m)] for i in range(2 * n)])


def test_up_bilinear_is_the_gather_of_four():
    a = np.random.default_rng(3).normal(size=(5, 4))
    assert np.allclose(up_bilinear(a), brute_up(a))


def test_single_point_is_finite():
    s, c = np.zeros((8, 8)), np.zeros((8, 8))
    s[4, 4], c[4, 4] = 100, 1
    val, sup = solve(s, c, 500, 2)
    assert np.isfinite(val).all() and np.isfinite(sup).all() and val[4, 4] == 100 and sup[4, 4] == 500


def test_undivisible_grid_raises():
    with pytest.raises(ValueError, match="divisible"):
        solve(np.zeros((7, 7)), np.zeros((7, 7)), 1, 2)


def test_dense_constant_field_stays():
    val, sup = solve(np.full((8, 8), 14.0), np.full((8, 8), 2.0), 1, 3)
    assert (val == 7).all() and (sup == 1).all()


def test_normalise_removes_the_pull_to_zero():
    s, c = np.zeros((16, 16)), np.zeros((16, 16))
    s[0, 0], c[0, 0] = 100, 1
    plain, _ = solve(s, c, 1, 3)
    kept, _ = solve(s, c, 1, 3, normalise=True)
    assert plain[6, 6] < 100 and np.allclose(kept[:8, :8], 100)


def test_frames_equal_arrays(spark):
    c, s = random_cells((16, 24))
    want = solve(s, c.astype(float), 100, 3, saturation=2)
    got = pull_push_frames(cell_frame(spark, c, s), (16, 24), 100, 3, saturation=2)
    assert np.allclose(dense(got, (16, 24), "val"), want[0]) and np.allclose(dense(got, (16, 24), "sup"), want[1])


@pytest.mark.parametrize("block", [8, 16, 20, 512])
def test_tiles_equal_the_whole_grid(spark, block):
    c, s = random_cells((50, 37), 2, 0.05)
    c[49, 36] = 1
    spec = GridSpec(0, 0, 1000, 50, 37, 3, 5000.0, block=block)
    wide = tuple(np.pad(a, [(0, spec.padded[0] - 50), (0, spec.padded[1] - 37)]).astype(float) for a in (s, c))
    val, sup = solve(*wide, 1000, 3)
    near = box_sum(wide[1], 5)
    got = surface(cell_frame(spark, c, s), spec).collect()
    assert {(r.ix, r.iy) for r in got} == {(i, j) for i, j in np.ndindex(50, 37) if near[i, j] > 0}
    assert all(abs(r.val - val[r.ix, r.iy]) < 1e-9 and abs(r.sup - sup[r.ix, r.iy]) < 1e-6 and r.near == near[r.ix, r.iy] for r in got)


@pytest.mark.parametrize("mask", [True, False])
def test_parts_of_a_tile_equal_the_whole_grid(spark, monkeypatch, mask):
    """Arrays of a tile stay as large as a part of it, and its values are those of the whole grid."""
    from gridloom.operators import surface as module

    c, s = random_cells((150, 70), 4, 0.01)
    c[149, 69] = 1
    wide = tuple(np.pad(a, [(0, 2), (0, 2)]).astype(float) for a in (s, c))
    val, sup = solve(*wide, 1000, 2)
    near = box_sum(wide[1], 3)

    def small(s, *args, **more):
        assert max(s.shape) <= 32 + 2 * 8
        return solve(s, *args, **more)

    # the function of the plan is called here too, with the rows of the one tile
    taken, grouped = [], type(cell_frame(spark, c, s).groupBy("ix"))
    plan_of = grouped.applyInArrow
    monkeypatch.setattr(grouped, "applyInArrow", lambda self, f, schema: taken.append((f, self)) or plan_of(self, f, schema))
    monkeypatch.setattr(module, "PART", 32)
    spec = GridSpec(0, 0, 1000, 150, 70, 2, 3000.0, block=512)
    got = surface(cell_frame(spark, c, s), spec, mask=mask).collect()
    want = {(i, j) for i, j in np.ndindex(150, 70) if near[i, j] > 0 or not mask}
    assert len(got) == len(want) and {(r.ix, r.iy) for r in got} == want
    assert all(abs(r.val - val[r.ix, r.iy]) < 1e-9 and abs(r.sup - sup[r.ix, r.iy]) < 1e-6 and r.near == near[r.ix, r.iy] for r in got)
    monkeypatch.setattr(module, "solve", small)
    i, j = np.nonzero(c)
    batch = pa.RecordBatch.from_pydict({"ix": i, "iy": j, "s": s[i, j], "c": c[i, j].astype(np.int64)})
    parts = list(taken[0][0]((pa.scalar(0), pa.scalar(0)), iter([batch.slice(0, 40), batch.slice(40)])))
    assert len(parts) > 1 and sum(p.num_rows for p in parts) == len(want)


def test_shift_by_a_coarse_cell_shifts_the_result():
    c, s = random_cells((32, 32), 5, 0.2)
    a, _ = solve(np.pad(s, [(0, 8), (0, 0)]), np.pad(c, [(0, 8), (0, 0)]).astype(float), 1, 3)
    b, _ = solve(np.pad(s, [(8, 0), (0, 0)]), np.pad(c, [(8, 0), (0, 0)]).astype(float), 1, 3)
    assert np.allclose(a[8:24], b[16:32])


def test_halo_beyond_block_raises():
    with pytest.raises(ValueError, match="halo .* exceeds block size"):
        GridSpec(0, 0, 500, 10, 10, 1, 1000.0, block=3)


@pytest.mark.parametrize("bad", [{"res": 0}, {"saturation": 0}, {"cap_m": -1}, {"scale": 400}, {"block": 0}])
def test_bad_geometry_raises(bad):
    with pytest.raises(ValueError):
        GridSpec(**({"x0": 0, "y0": 0, "res": 500, "nx": 4, "ny": 4, "levels": 1, "cap_m": 0.0} | bad))


def test_unknown_upsampling_raises(spark):
    c, s = random_cells((4, 4))
    with pytest.raises(ValueError, match="upsampling"):
        surface(cell_frame(spark, c + 1, s), GridSpec(0, 0, 1, 4, 4, 1, 0.0), upsample="cubic")
