import numpy as np
import pytest
from gridloom import PercentileTransform, blocked_cv_skill, choose_transform, icc, make_transform, transforms
from gridloom.operators import calibrate
from pyspark.sql import functions as F


def points(spark, x, y, v):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, v, strict=True)], "x double, y double, v double")


def test_percentile_round_trip(spark):
    v = np.random.default_rng(0).exponential(10, 1000)
    df = points(spark, v, v, v)
    t = PercentileTransform().fit(df, "v")
    got = df.select("v", t.fwd(F.col("v")).alias("p"), t.inv(t.fwd(F.col("v"))).alias("back")).toPandas()
    assert got.p.between(0, 100).all() and np.allclose(got.back, got.v, rtol=0.02, atol=1e-6)
    assert np.allclose(got.p, np.interp(got.v, t.quantiles, np.linspace(0, 100, 1001)))


def test_percentile_ties_take_the_low_end(spark):
    v = [1.0] * 50 + [2.0] * 50 + [3.0] * 100
    df = points(spark, v, v, v)
    t = PercentileTransform().fit(df, "v")
    got = {r.v: round(r.p, 1) for r in df.select("v", t.fwd(F.col("v")).alias("p")).distinct().collect()}
    assert got == {1.0: 0.0, 2.0: 25.2, 3.0: 50.3}


def test_percentile_of_exact_halves_is_exact(spark):
    """Values of two decimals half-way between two knots of the table, which a step added to each knot would move."""
    from gridloom.functions.transforms import rising

    q = np.arange(101) / 100 + 5000
    half = q[:-1] + 0.005
    got = points(spark, half, half, half).select("v", PercentileTransform(rising(q)).fwd(F.col("v")).alias("p")).toPandas()
    assert np.allclose(got.p, np.arange(100) + (got.v - q[:-1]) / (q[1:] - q[:-1]), rtol=0, atol=1e-12)


def test_percentile_between_ties(spark):
    t = PercentileTransform([1.0, 1.0, 2.0, 2.0, 2.0, 4.0])
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0, float("nan"), None)], "v double")
    assert [r.p for r in df.select(t.fwd(F.col("v")).alias("p")).collect()] == [0.0, 0.0, 30.0, 40.0, 90.0, 100.0, 100.0, None, None]


def test_unfitted_percentile_raises():
    with pytest.raises(ValueError, match="not fitted"):
        PercentileTransform().fwd(F.lit(1.0))


def test_unknown_transform():
    with pytest.raises(ValueError, match="Unknown transform"):
        make_transform({"name": "foobar"})


def test_transforms_are_new_each_time():
    assert [t.name for t in transforms()] == ["identity", "log10", "sqrt", "percentile"]
    assert transforms()[3] is not transforms()[3]


def test_icc_against_arrays(spark):
    r = np.random.default_rng(1)
    x, y = r.uniform(0, 1000, (2, 400))
    v = np.floor(x / 100) + r.normal(size=400)
    got = calibrate.icc_table(points(spark, x, y, v), (x.min(), y.min()), (100.0, 300.0)).collect()
    for row in got:
        key = np.floor((x - x.min()) / row.scale) * 1000 + np.floor((y - y.min()) / row.scale)
        mean = {k: v[key == k].mean() for k in set(key)}
        want = 1 - np.mean((v - np.array([mean[k] for k in key])) ** 2) / v.var()
        assert abs(row.icc - want) < 1e-9


@pytest.mark.parametrize("scales", [(100.0, 300.0, 900.0), (300.0, 100.0), (100.0, 250.0), (0.1, 0.3, 0.7, 0.2)])
def test_icc_by_keys_and_scales_that_nest_or_not(spark, scales):
    """Coordinates on and beside the cells' edges; values far from 0; two groups of points."""
    r = np.random.default_rng(5)
    x, y = (scales[0] * np.nextafter(r.integers(0, 60, 600), r.choice([-1e9, 1e9], 600)) + 7.5 for _ in range(2))
    v, g = 1e7 + np.floor(x / scales[0] / 5) + r.normal(size=600), r.integers(0, 2, 600)
    df = spark.createDataFrame([(*map(float, row), int(k)) for *row, k in zip(x, y, v, g, strict=True)], "x double, y double, v double, g int").repartition(3)
    got = calibrate.icc_table(df, (7.5, 7.5), scales, keys=["g"]).collect()
    assert len(got) == 2 * len(scales)
    for row in got:
        own = g == row.g
        key = list(zip(*(np.floor((c[own] - 7.5) / row.scale) for c in (x, y)), strict=True))
        mean = {k: np.mean([a for a, b in zip(v[own], key, strict=True) if b == k]) for k in set(key)}
        assert abs(row.icc - (1 - np.mean((v[own] - np.array([mean[k] for k in key])) ** 2) / v[own].var())) < 1e-9


def test_points_of_the_scores_are_not_multiplied(spark):
    """One row per point and no more reaches the first aggregation, whatever the scales and transforms."""
    r = np.random.default_rng(6)
    x, y = r.uniform(0, 1e5, (2, 300))
    df = points(spark, x, y, r.exponential(10, 300))
    for table in (calibrate.icc_table(df, (0.0, 0.0)), calibrate.transform_scores(df)[0]):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("explode") <= 2 and plan.rindex("explode") < plan.rindex("Aggregate")


def test_icc_without_variance_is_zero(spark):
    got = calibrate.icc_table(points(spark, [0, 1], [0, 1], [5, 5]), (0, 0), (10.0,)).first()
    assert got.icc == 0


def test_choose_transform(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(0, 1e5, (2, 300))
    best, scores = choose_transform(points(spark, x, y, r.exponential(10, 300)))
    assert best.name in {"identity", "log10", "sqrt", "percentile"} and len(scores) == 4
    assert [s[1] for s in scores] == sorted((s[1] for s in scores), reverse=True)


def test_choose_transform_skips_what_does_not_apply(spark):
    _, scores = choose_transform(points(spark, [0, 1e5, 2e5], [0, 0, 1e5], [-1, 2, 3]))
    assert {s[0] for s in scores} == {"identity", "percentile"}


def test_folds_are_the_seeded_permutation(spark):
    p = points(spark, range(10), [0] * 10, [0] * 10)
    got = {r.bx: r.fold for r in calibrate.block_folds(p, (0, 0), 1.0, 4, 0).collect()}
    perm = np.random.default_rng(0).permutation(10)
    assert got == {int(b): f for f, part in enumerate(np.array_split(perm, 4)) for b in part}


def test_hashed_folds_divide_the_blocks(spark):
    p = points(spark, range(10), [0] * 10, [0] * 10)
    got = [r.fold for r in calibrate.block_folds(p, (0, 0), 1.0, 4, deal="hash").collect()]
    assert sorted(got) == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    with pytest.raises(ValueError, match="deal folds"):
        calibrate.block_folds(p, (0, 0), 1.0, deal="other")


def test_icc_of_one_scale(spark):
    p = points(spark, [0, 1, 10, 11], [0, 0, 0, 0], [1, 1, 5, 5])
    assert icc(p, 5.0) == pytest.approx(1.0) and icc(p, 100.0) == pytest.approx(0.0)


def test_resampling_weights_follow_the_poisson_law():
    for keys in (np.arange(4000), np.random.default_rng(3).integers(-(2**62), 2**62, 4000)):
        w = calibrate.poisson_weights(keys, 200, 0)
        assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
        assert abs(w.mean(axis=1).var() * 4000 - 1) < 0.35 and abs(w.mean(axis=0).var() * 200 - 1) < 0.15  # replicates and points vary as independent draws do
        near = np.corrcoef(w[:, :300].T)[np.triu_indices(300, 1)]
        assert abs(near.mean()) < 0.005
    assert (calibrate.poisson_weights(np.arange(5), 3, 0) != calibrate.poisson_weights(np.arange(5), 3, 1)).any()


def test_bootstrap_does_not_depend_on_partitions(spark):
    x, y, v = smooth(spark, 1500)
    p = calibrate.cv_predictions(points(spark, x, y, v), 1000.0, 5, [20.0]).persist()
    got = [sorted(map(tuple, calibrate.bootstrap_ci(p.repartition(n), n_boot=20, min_n=30).collect())) for n in (1, 7)]
    assert got[0] and np.allclose(got[0], got[1], rtol=1e-12)


def test_weights_are_drawn_once_for_all_block_sizes(spark):
    """Bounds by point are those of each block size by itself, from a single draw of weights for each point."""
    x, y, v = smooth(spark, 900)
    cv = calibrate.CrossValidation(points(spark, x, y, v), 1000.0, 5, [10.0, 20.0, 35.5])
    cv.cells = cv.cells.persist()
    rows = cv.by_point().persist()
    assert rows.count() == 900 and cv.points().count() == 2700
    got = sorted(map(tuple, calibrate.bootstrap_ci(rows, n_boot=20, min_n=30, cells=cv.cells).collect()))
    want = []
    for km in (10.0, 20.0, 35.5):
        p = cv.points().where(F.col("block_km") == km).toPandas()
        w = calibrate.poisson_weights(p.key.to_numpy(), 20, 0)
        x0 = (p.key.to_numpy() % calibrate.MODULUS)[None, :] * calibrate.FACTOR + (np.arange(1, 21) * calibrate.STRIDE)[:, None]
        for _ in range(calibrate.ROUNDS):
            x0 = (x0 % calibrate.MODULUS) ** 2 + calibrate.FACTOR
        assert (w == np.searchsorted(calibrate.POISSON, x0 % calibrate.MODULUS, side="right")).all()
        m, b = (p.act - p.pred).to_numpy() ** 2, (p.act - p.act.mean()).to_numpy() ** 2
        for lo, hi in zip(calibrate.EDGES, calibrate.EDGES[1:], strict=False):
            at = ((p.sup_km >= lo) & (p.sup_km < hi)).to_numpy()
            if at.sum() >= 30:
                want.append((km, hi, *np.quantile(1 - np.sqrt(w[:, at] @ m[at]) / np.sqrt(w[:, at] @ b[at]), [0.05, 0.95])))
    assert len(got) > 5 and np.allclose(got, sorted(want), rtol=1e-9)


def test_skill_from_cells_equals_skill_from_points(spark):
    x, y, v = smooth(spark, 1500)
    cv = calibrate.CrossValidation(points(spark, x, y, v + 1000), 1000.0, 5, [10.0, 20.0])
    for f in (lambda t: calibrate.skill_bins(t, min_n=20), calibrate.overall_skill):
        a, b = (np.array(sorted(map(tuple, f(t).collect()))) for t in (cv.cells, cv.points()))
        assert len(a) and np.allclose(a, b, atol=1e-6)


def test_blocked_skill(spark):
    x, y, v = smooth(spark)
    overall, rows = blocked_cv_skill(points(spark, x, y, v), levels=6, block_km=20.0, n_boot=20, min_n=30)
    assert overall > 0.5 and rows and {"lo_km", "hi_km", "n", "skill", "ci_lo", "ci_hi"} <= set(rows[0])
    overall, rows = blocked_cv_skill(points(spark, [0, 1], [0, 1], [1, 2]), levels=3)
    assert np.isnan(overall) and rows == []


def smooth(spark, n=3000):
    r = np.random.default_rng(2)
    x, y = r.uniform(0, 1.5e5, n), r.uniform(0, 4e4, n)
    return x, y, 10 + ((x - 7e4) / 1e4) ** 2 + ((y - 2e4) / 1e4) ** 2


def test_predictions_are_those_of_each_fold(spark):
    from gridloom.operators.surface import solve

    x, y, v = smooth(spark, 500)
    df = points(spark, x, y, v)
    got = sorted((r.act, r.pred, r.sup_km) for r in calibrate.cv_predictions(df, 1000.0, 5, [20.0]).collect())
    folds = {(r.bx, r.by): r.fold for r in calibrate.block_folds(df, (x.min(), y.min()), 2e4).collect()}
    at = lambda res: (np.floor((x - x.min()) / res).astype(int), np.floor((y - y.min()) / res).astype(int))
    fold = np.array([folds[k] for k in zip(*map(list, at(2e4)), strict=True)])
    ix, iy = at(1000.0)
    shape = tuple(-(-(int(k.max()) + 1) // 32) * 32 for k in (ix, iy))
    want = []
    for f in range(4):
        s, c = np.zeros(shape), np.zeros(shape)
        np.add.at(s, (ix[fold != f], iy[fold != f]), v[fold != f])
        np.add.at(c, (ix[fold != f], iy[fold != f]), 1)
        val, sup = solve(s, c, 1000.0, 5)
        want += [(v[k], val[ix[k], iy[k]], sup[ix[k], iy[k]] / 1000) for k in np.flatnonzero(fold == f)]
    assert np.allclose(got, sorted(want))


def test_fill_cap_of_a_smooth_field_and_of_noise(spark):
    x, y, v = smooth(spark)
    cap, detail = calibrate.calibrate_fill_cap(points(spark, x, y, v), (10.0, 20.0, 40.0), levels=6, n_boot=50, min_n=30)
    assert cap in (4.0, 8.0, 16.0) and set(detail) == {10.0, 20.0, 40.0}
    assert all(r["ci_lo"] <= r["skill"] + 0.05 and r["ci_lo"] <= r["ci_hi"] for d in detail.values() for r in d["rows"])
    noise = np.random.default_rng(4).normal(size=len(x))
    assert calibrate.calibrate_fill_cap(points(spark, x, y, noise), (10.0, 20.0), levels=6, n_boot=50)[0] == 25.0


def test_one_block_gives_the_default(spark):
    cap, detail = calibrate.calibrate_fill_cap(points(spark, [0, 10, 20], [0, 10, 5], [1, 2, 3]), (50.0,), levels=3, n_boot=10)
    assert cap == 25.0 and detail[50.0]["rows"] == []


@pytest.mark.parametrize(("rows", "want"), [([(2, 50, 0.3), (2, 100, 0.01), (8, 50, 0.2), (32, 100, 0.1), (64, 200, 0.02)], 32), ([], 25), ([(64, 100, 0.9)], 25), ([(2, 50, 0.01), (4, 50, 0.9)], 25)])
def test_cap_rule(spark, rows, want):
    curve = spark.createDataFrame([tuple(map(float, r)) for r in rows], "hi_km double, block_km double, ci_lo double")
    assert calibrate.cap_from_curve(curve).first()[0] == want


@pytest.mark.parametrize("v", [[5.0], [1.0, 2.0], [3.0] * 40 + [1.0, 9.0], list(np.random.default_rng(9).normal(size=5000)), list(np.arange(1001.0)), [0.0] * 5 + [2.0] * 700])
@pytest.mark.parametrize("knots", [11, 1001])
@pytest.mark.parametrize("few", [0, 200_000])
def test_quantiles_equal_numpy(spark, v, knots, few, monkeypatch):
    from gridloom.functions import transforms as t
    from gridloom.functions.transforms import quantiles

    monkeypatch.setattr(t, "FEW", few)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3)
    assert np.allclose(quantiles(df, "v", knots), np.quantile(v, np.linspace(0, 1, knots)), rtol=0, atol=1e-9)
