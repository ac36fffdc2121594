"""Calibration curves: recovery, monotony, inversion, and Spark columns equal to numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import curves
from massloom.operators import calibrate


def test_isotonic():
    assert curves.isotonic(np.array([1.0, 3, 2, 4])).tolist() == [1, 2.5, 2.5, 4]
    assert curves.isotonic(np.array([3.0, 1.0]), np.array([3.0, 1.0])).tolist() == [2.5, 2.5]
    assert len(curves.isotonic(np.empty(0))) == 0


def test_recovers_a_line_and_stays_monotone():
    x = np.linspace(0, 100, 200)
    curve = curves.fit(x, 2 * x + 5)
    assert np.allclose(curves.evaluate(curve, [-10, 3, 50, 120]), [-15, 11, 105, 245], atol=1e-6)
    rng = np.random.default_rng(1)
    curve = curves.fit(x, 40 / (1 + np.exp(-(x - 50) / 9)) + rng.normal(0, 1.0, 200))
    assert (np.diff(curves.evaluate(curve, np.linspace(0, 100, 2000))) >= -1e-6).all()


def test_few_and_ragged():
    assert curves.fit([1, 2, 3, 4], [1, 2, 3, 4]) is None
    with pytest.raises(ValueError):
        curves.fit([1, 2], [1])
    assert curves.fit([1] * 10, list(range(10))) is not None


def test_mask():
    y = np.linspace(0, 100, 200)
    assert curves.keep_mask(y[:49]).all()
    y[150] = 0
    assert not curves.keep_mask(y)[150] and curves.keep_mask(y).sum() == 199


def test_fallback_is_monotone():
    x = np.linspace(0, 10, 60)
    knots, c = curves.loess_curve(x, np.sqrt(x))
    assert (np.diff(c[:, 0]) >= 0).all() and abs(curves.evaluate((knots, c), 4.0) - 2) < 0.1


def test_columns_equal_numpy(spark):
    x = np.linspace(0, 100, 300)
    curve = curves.fit(x, np.sqrt(x + 1) * 10)
    rows = spark.createDataFrame([(float(v),) for v in np.linspace(-20, 130, 61)], "x double")
    knots, coeffs = (F.array(*map(F.lit, v.ravel().tolist())) for v in curve)
    got = rows.select("x", curves.value_at(F.col("x"), knots, coeffs).alias("y")).withColumn("back", curves.inverse_at(F.col("y"), knots, coeffs)).toPandas()
    assert np.allclose(got.y, curves.evaluate(curve, got.x), atol=1e-9)
    inside = got[(got.x > curve[0][0]) & (got.x < curve[0][-1])]
    assert np.allclose(inside.back, inside.x, atol=1e-2)


def test_policy(spark):
    rows = [(k, float(i), 2.0 * i, 0.001) for k, n in (("none", 9), ("line", 50), ("spline", 150)) for i in range(n)]
    df = spark.createDataFrame(rows, "run string, exp double, pred double, evalue double")
    got = {r["run"]: r["kind"] for r in calibrate.fit_curves(df, ("run",)).collect()}
    assert got == {"none": "none", "line": "linear", "spline": "spline"}


def plain_value(knots, coeffs, x):
    """The curve at one x, by the textbook form of the cubic between two knots and a line outside."""
    if x <= knots[0] or len(knots) == 1:
        return coeffs[0][0] + coeffs[0][1] * (x - knots[0])
    if x >= knots[-1]:
        return coeffs[-1][0] + coeffs[-1][1] * (x - knots[-1])
    k = max(i for i, p in enumerate(knots) if p < x)
    w = knots[k + 1] - knots[k]
    t = (x - knots[k]) / w
    (y0, d0), (y1, d1) = coeffs[k], coeffs[k + 1]
    return y0 * (2 * t**3 - 3 * t**2 + 1) + w * d0 * (t**3 - 2 * t**2 + t) + y1 * (3 * t**2 - 2 * t**3) + w * d1 * (t**3 - t**2)


def plain_fit(x, y):
    """Isotonic levels by the min-max formula, knots by equal counts, and the least squares of the textbook basis by numpy."""
    n = len(x)
    upto = np.concatenate(([0.0], np.cumsum(y)))
    mean = np.full((n, n), np.nan)
    for j in range(n):
        mean[j, j:] = (upto[j + 1 :] - upto[j]) / np.arange(1, n - j + 1)
    level = [max(np.nanmin(mean[j, i:]) for j in range(i + 1)) for i in range(n)]
    m = min(20, max(1, int(2 * (n / 20) ** 0.5)))
    edges = [x[min(int((n - 1) / m * k), n - 1)] for k in range(m)] + [x[-1]]
    knots = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    if m >= 2:
        knots[0], knots[-1] = x[int(0.001 * (n - 1))], x[int(0.999 * (n - 1))]
    rows = []
    for v in x:
        row = []
        for k in range(len(knots)):
            for unit in ((1.0, 0.0), (0.0, 1.0)):
                row.append(plain_value(knots, [unit if i == k else (0.0, 0.0) for i in range(len(knots))], v))
        rows.append(row)
    solved = np.linalg.lstsq(np.array(rows), np.array(level), rcond=1e-13)[0]
    return np.array(level), np.array(knots), solved.reshape(-1, 2)


def test_steps_of_the_fit_equal_a_plain_version():
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(0, 60, 160))
    y = 30 / (1 + np.exp(-(x - 30) / 8)) + rng.normal(0, 0.6, 160)
    level, knots, coeffs = plain_fit(x, y)
    assert np.allclose(curves.isotonic(y), level)
    assert np.allclose(curves.knot_places(x), knots)
    got = curves.least_squares(curves.basis(curves.knot_places(x), x), curves.isotonic(y)).reshape(-1, 2)
    at = np.linspace(-5, 70, 500)
    want = np.array([plain_value(knots, coeffs, v) for v in at])
    assert np.allclose(curves.evaluate((curves.knot_places(x), got), at), want, atol=1e-6)


def test_monotone_repair_equals_a_plain_version():
    """A curve that descends is replaced by the interpolant of its running maximum with slopes held in the circle of radius 3."""
    knots, coeffs = np.array([0.0, 1, 2, 3]), np.array([[0.0, 1], [2, 0], [1, -1], [4, 2]])
    xs = np.linspace(0, 3, 512)
    top = np.maximum.accumulate([plain_value(knots, coeffs, v) for v in xs])
    slopes = np.diff(top) / np.diff(xs)
    t = [slopes[0], *((a + b) / 2 for a, b in zip(slopes, slopes[1:], strict=False)), slopes[-1]]
    for k, d in enumerate(slopes):
        if abs(d) < 1e-12:
            t[k] = t[k + 1] = 0.0
        elif t[k] ** 2 + t[k + 1] ** 2 > 9 * d * d:
            scale = 3 * abs(d) / (t[k] ** 2 + t[k + 1] ** 2) ** 0.5
            t[k], t[k + 1] = t[k] * scale, t[k + 1] * scale
    at = np.linspace(-1, 4, 300)
    got = curves.evaluate(curves.monotone((knots, coeffs), 0, 3), at)
    assert np.allclose(got, [plain_value(xs, list(zip(top, t, strict=True)), v) for v in at], atol=1e-9)
    rising = curves.line([0, 1], [0, 2])
    assert curves.monotone(rising, 0, 1) is rising


def test_local_lines_equal_a_plain_version():
    rng = np.random.default_rng(6)
    x = np.sort(rng.uniform(0, 10, 80))
    y = np.sin(x / 4) * 5 + rng.normal(0, 0.2, 80)
    robust, near = np.ones(80), int(0.3 * 80)

    def smooth(p):
        d = np.abs(x - p)
        reach = sorted(d)[near - 1] * 1.001 + 1e-12
        w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3 * robust
        slope, base = np.polyfit(x, y, 1, w=np.sqrt(w))
        return base + slope * p

    for _ in range(2):
        residual = np.abs(y - np.array([smooth(p) for p in x]))
        robust = np.clip(1 - (residual / (6 * np.median(residual))) ** 2, 0, None) ** 2
    at = np.linspace(0.5, 9.5, 40)
    assert np.allclose(curves.loess(x, y, at, 0.3), [smooth(p) for p in at], atol=1e-6)


def test_inverse_column_is_the_bisection(spark):
    """The column form of the inversion goes the way of the numpy form: the same answers for splines, lines and outside values."""
    x = np.linspace(0, 100, 300)
    for curve in (curves.fit(x, np.sqrt(x + 1) * 10), curves.fit(x, 40 / (1 + np.exp(-(x - 50) / 9))), curves.line(x, 3 * x + 1), curves.line([1, 2], [5, 5])):
        y = np.linspace(-20, 130, 301)
        knots, coeffs = (F.array(*map(F.lit, v.ravel().tolist())) for v in curve)
        got = spark.createDataFrame([(float(v),) for v in y], "y double").select("y", curves.inverse_at(F.col("y"), knots, coeffs).alias("x")).toPandas()
        assert np.allclose(got.x, curves.invert(curve, got.y), atol=1e-9)
        inside = got[(got.x > curve[0][0]) & (got.x < curve[0][-1])]
        assert all(abs(plain_value(curve[0], curve[1], v) - want) < 2e-4 for v, want in zip(inside.x, inside.y, strict=True))


def test_curve_queries_by_value(spark, sf):
    """Calibrated values, grids and normalised deltas of all runs equal those of the fitted curves, evaluated one by one."""
    from massloom.plans import files

    fits = {r["run"]: (np.array(r["knots"]), np.array(r["coeffs"]).reshape(-1, 2)) for r in files.QUERIES["fit_policy"](spark, sf).collect() if r["kind"] != "none"}
    assert len(fits) == 4 and all(len(k) > 5 for k, _ in fits.values())
    for name in ("curve_eval", "calibration_curve_samples"):
        rows = files.QUERIES[name](spark, sf).toPandas()
        assert all(abs(plain_value(*fits[r.run], r.x) - r.y) < 1e-9 for r in rows.itertuples())
    grid = files.QUERIES["calibration_grid"](spark, sf).toPandas()
    assert len(grid) == 40_000 and all(np.allclose(g.y, curves.invert(fits[run], g.x), atol=1e-9) for run, g in grid.groupby("run"))
    table = files.QUERIES["calibration_table"](spark, sf).toPandas().sort_values(["run", "x"])
    assert np.allclose(table.y, grid.sort_values(["run", "x"]).y)
    psms = files._psms(spark, sf).select("psm_id", "run", "exp_rt", "pred_rt").toPandas().set_index("psm_id")
    found = files.QUERIES["calibrated_rt"](spark, sf).toPandas().set_index("psm_id").join(psms)
    assert len(found) == len(psms)
    for run, g in found.groupby("run"):
        assert np.allclose(g.calibrated_rt, curves.invert(fits[run], g.exp_rt), atol=1e-9)
    assert np.allclose(found.delta_rt_loess, np.minimum(abs(found.calibrated_rt - found.pred_rt), 1000))
    inverted = files.QUERIES["curve_invert"](spark, sf).toPandas().set_index("psm_id").join(found[["calibrated_rt"]])
    assert np.allclose(inverted.calibrated, inverted.calibrated_rt)
