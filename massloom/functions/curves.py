"""Monotone calibration curves: numpy fits of one bounded group, and their evaluation as Spark columns.

A curve is a piecewise cubic Hermite function: knots, and for each knot a value and a slope. Outside the knots it is a
line; a curve with one knot is a line altogether.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the fit.
FEWEST, MOST_SEGMENTS, EDGE, CUTOFF, SAMPLES = 5, 20, 0.999, 1e-12, 512
MASK_FEWEST, MASK_HALF, MASK_DIVISOR, MASK_QUANTILE, MASK_MARGIN = 50, 20, 80, 0.75, 0.18
BANDWIDTHS, FOLDS, CONTROLS, CENTRAL_SLOPE, PLATEAU = (0.05, 0.10, 0.15, 0.20, 0.30), 3, 25, 1e-3, 0.3

Curve = tuple[np.ndarray, np.ndarray]  #: knots, and rows of (value, slope)


def evaluate(curve: Curve, x) -> np.ndarray:
    knots, c = curve
    x = np.asarray(x, float)
    if len(knots) == 1:
        return c[0, 0] + c[0, 1] * (x - knots[0])
    k = np.clip(np.searchsorted(knots, x, "left") - 1, 0, len(knots) - 2)
    w = knots[k + 1] - knots[k]
    flat = w < 1e-12
    u = (x - knots[k]) / np.where(flat, 1.0, w)
    v = u - 1
    inner = (1 + 2 * u) * v * v * c[k, 0] + w * u * v * v * c[k, 1] + u * u * (1 - 2 * v) * c[k + 1, 0] + w * u * u * v * c[k + 1, 1]
    inner = np.where(flat, c[k, 0], inner)
    out = np.where(x <= knots[0], c[0, 0] + c[0, 1] * (x - knots[0]), inner)
    return np.where(x >= knots[-1], c[-1, 0] + c[-1, 1] * (x - knots[-1]), out)


def isotonic(y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing values."""
    weight = np.ones(len(y)) if weight is None else weight
    level, mass, size = [], [], []
    for value, w in zip(y.tolist(), weight.tolist(), strict=True):
        level.append(value), mass.append(w), size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            m = mass[-2] + mass[-1]
            mean = (level[-2] * mass[-2] + level[-1] * mass[-1]) / m if m > 0 else (level[-2] + level[-1]) / 2
            n = size.pop() + size.pop()
            del level[-2:], mass[-2:]
            level.append(mean), mass.append(m), size.append(n)
    return np.repeat(level, size)


def unit_weights(weight, n: int) -> np.ndarray:
    """Weights scaled to a largest one of 1; all ones where none is given or positive."""
    if weight is None or np.max(weight, initial=0.0) <= 0:
        return np.ones(n)
    return np.maximum(weight, 0.0) / np.max(weight)


def keep_mask(y: np.ndarray) -> np.ndarray:
    """False for values that lie far under the high level of their rank window."""
    n = len(y)
    margin = MASK_MARGIN * (np.max(y) - np.min(y)) if n else 0.0
    if n < MASK_FEWEST or not np.isfinite(margin) or margin <= 0:
        return np.ones(n, bool)
    half = max(MASK_HALF, n // MASK_DIVISOR)
    high = np.array([np.sort(part)[int((len(part) - 1) * MASK_QUANTILE)] for i in range(n) for part in [y[max(0, i - half) : i + half + 1]]])
    return y >= high - margin


def knot_places(x: np.ndarray) -> np.ndarray:
    """Midpoints of equal-count splits; the outer two at the 0.1 % and 99.9 % places; equal neighbours once."""
    n = len(x)
    m = min(MOST_SEGMENTS, max(1, int(2 * np.sqrt(n / 20))))
    edges = np.append(x[np.minimum(((n - 1) / m * np.arange(m)).astype(int), n - 1)], x[-1])
    knots = (edges[:-1] + edges[1:]) / 2
    if m >= 2:
        knots[0], knots[-1] = x[int((1 - EDGE) * (n - 1))], x[int(EDGE * (n - 1))]
    kept = [knots[0]]
    for k in knots[1:]:
        if k - kept[-1] >= 1e-10:
            kept.append(k)
    return np.array(kept)


def basis(knots: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row i holds the factors of the knots' values and slopes at x[i]: cubic between knots, linear outside."""
    m, n = len(knots), len(x)
    a = np.zeros((n, m, 2))
    right = np.searchsorted(knots, x, "left")
    rows = np.arange(n)
    low, high = right == 0, right == m
    a[low, 0, 0], a[low, 0, 1] = 1.0, x[low] - knots[0]
    a[high, m - 1, 0], a[high, m - 1, 1] = 1.0, x[high] - knots[-1]
    inner = rows[~low & ~high]
    r = right[inner]
    w = knots[r] - knots[r - 1]
    u = (x[inner] - knots[r - 1]) / w
    v = u - 1
    a[inner, r - 1, 0], a[inner, r - 1, 1] = (1 + 2 * u) * v * v, w * u * v * v
    a[inner, r, 0], a[inner, r, 1] = u * u * (1 - 2 * v), w * u * u * v
    return a.reshape(n, 2 * m)


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Truncated pseudo-inverse solution; None if something is not finite."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return None
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    inverse = np.divide(1.0, s, out=np.zeros_like(s), where=s > CUTOFF)
    x = vt.T @ (inverse * (u.T @ b))
    return x if np.isfinite(x).all() else None


def through(knots: np.ndarray, values: np.ndarray) -> Curve:
    """Monotone cubic interpolant: mean slopes, held inside the circle of radius 3 of each piece's slope."""
    dx = np.diff(knots)
    slope = np.divide(np.diff(values), dx, out=np.zeros(len(dx)), where=dx > 1e-12)
    t = np.concatenate(([slope[0]], (slope[:-1] + slope[1:]) / 2, [slope[-1]]))
    for k, d in enumerate(slope):
        if abs(d) < 1e-12:
            t[k] = t[k + 1] = 0.0
        elif (size := (t[k] ** 2 + t[k + 1] ** 2) / d**2) > 9:
            t[k : k + 2] *= 3 / np.sqrt(size)
    return knots, np.stack([values, t], 1)


def monotone(curve: Curve, low: float, high: float) -> Curve:
    """The curve, or the interpolant of its running maximum where it descends between low and high."""
    if high <= low:
        return curve
    x = low + (high - low) * np.arange(SAMPLES) / (SAMPLES - 1)
    y = evaluate(curve, x)
    return through(x, np.maximum.accumulate(y)) if (np.diff(y) < -1e-6).any() else curve


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, bandwidth: float, weight: np.ndarray | None = None, passes: int = 2) -> np.ndarray:
    """Local lines with tricube weights over the nearest part of the points, ``passes`` times down-weighting far residuals."""
    n, near = len(x), max(2, int(bandwidth * len(x)))
    weight = np.ones(n) if weight is None else weight
    robust = np.ones(n)

    def smooth(places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places))
        for i, p in enumerate(places):
            d = np.abs(x - p)
            reach = np.partition(d, near - 1)[near - 1] * 1.001 + 1e-12
            w = np.maximum(0, 1 - (d / reach) ** 3) ** 3 * robust * weight
            total = w.sum()
            if total <= 0:
                out[i] = np.interp(p, x, y)
                continue
            mx, my = (w * x).sum() / total, (w * y).sum() / total
            var = (w * (x - mx) ** 2).sum()
            out[i] = my + (p - mx) * ((w * (x - mx) * (y - my)).sum() / var if var > 1e-12 else 0.0)
        return out

    for _ in range(passes):
        residual = np.abs(y - smooth(x))
        scale = 6 * np.median(residual)
        if scale <= 1e-12:
            break
        robust = np.maximum(0, 1 - (residual / scale) ** 2) ** 2
    return smooth(at)


def loess_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Curve | None:
    """Fallback: bandwidth by three-fold cross-validation, local lines, isotonic, 25 control points, a leading plateau turned into the central slope."""
    n = len(x)
    if n < FEWEST:
        return None
    fold, least, best = np.arange(n) % FOLDS, max(3 / n, 0.01), (np.inf, 0.15)
    for candidate in BANDWIDTHS:
        width, error, seen = max(candidate, least), 0.0, 0
        for f in range(FOLDS):
            xt, yt = x[fold != f], y[fold != f]
            if len(xt) >= 4:
                got = loess(xt, yt, np.clip(x[fold == f], xt[0], xt[-1]), max(width, 3 / len(xt)))
                error, seen = error + ((got - y[fold == f]) ** 2).sum(), seen + (fold == f).sum()
        if seen and error / seen < best[0]:
            best = (error / seen, width)
    level = isotonic(loess(x, y, x, best[1], unit_weights(weight, n)))
    if not np.isfinite(level).all():
        return None
    knots = np.linspace(x[0], x[-1], CONTROLS)
    knots, c = through(knots, np.interp(knots, x, level))
    middle = slice(n // 4, 3 * n // 4)
    if n >= 8 and np.ptp(x[middle]) > 0:
        slope = np.polyfit(x[middle], y[middle], 1)[0]
        rising = np.flatnonzero(c[:, 0] - c[0, 0] > PLATEAU)
        if np.isfinite(slope) and slope >= CENTRAL_SLOPE and len(rising):
            k = rising[0]
            c[:k, 0] = c[k, 0] - slope * (knots[k] - knots[:k])
            c[: k + 1, 1] = slope
    return knots, c


def fit(x, y, weight=None) -> Curve | None:
    """A monotone curve through anchors; None for fewer than five.

    Anchors are sorted, far low ones dropped, equal x moved apart by 1e-8. The values are made isotonic and fitted by
    least squares on the Hermite basis; where that fails, local lines take over. A descending result is repaired.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) != len(y) or (weight is not None and len(weight) != len(x)):
        raise ValueError("x, y and weight must be equally long")
    if len(x) < FEWEST:
        return None
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    weight = None if weight is None else np.asarray(weight, float)[order]
    mask = keep_mask(y)
    if FEWEST <= mask.sum() < len(x):
        x, y, weight = x[mask], y[mask], None if weight is None else weight[mask]
    x = x.copy()
    for i in range(1, len(x)):
        if x[i] <= x[i - 1]:
            x[i] = x[i - 1] + 1e-8
    w = unit_weights(weight, len(x))
    level = isotonic(y, None if weight is None else w)
    knots = knot_places(x)
    root = np.sqrt(w)
    solved = least_squares(basis(knots, x) * root[:, None], level * root)
    curve = (knots, solved.reshape(-1, 2)) if solved is not None else loess_curve(x, y, weight)
    return None if curve is None else monotone(curve, x[0], x[-1])


def line(x, y) -> Curve:
    x, y = np.asarray(x, float), np.asarray(y, float)
    var = ((x - x.mean()) ** 2).sum()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / var if var > 0 else 0.0
    return np.array([0.0]), np.array([[y.mean() - slope * x.mean(), slope]])


def _hermite(u: Column, w: Column, v0: Column, s0: Column, v1: Column, s1: Column) -> Column:
    v = u - 1
    return (1 + 2 * u) * v * v * v0 + w * u * v * v * s0 + u * u * (1 - 2 * v) * v1 + w * u * u * v * s1


def value_at(x: Column, knots: Column, coeffs: Column) -> Column:
    """The curve's value at x as a column; coeffs holds value and slope of each knot in turn."""
    n = F.size(knots)
    k = F.least(F.greatest(F.size(F.filter(knots, lambda p: p < x)), F.lit(1)), n - 1)
    at = F.element_at
    p0 = at(knots, k)
    w = at(knots, k + 1) - p0
    inner = _hermite((x - p0) / w, w, at(coeffs, 2 * k - 1), at(coeffs, 2 * k), at(coeffs, 2 * k + 1), at(coeffs, 2 * k + 2))
    first = at(coeffs, F.lit(1)) + at(coeffs, F.lit(2)) * (x - at(knots, F.lit(1)))
    last = at(coeffs, 2 * n - 1) + at(coeffs, 2 * n) * (x - at(knots, n))
    return F.when(x <= at(knots, F.lit(1)), first).when(x >= at(knots, n), last).otherwise(inner)


def inverse_at(y: Column, knots: Column, coeffs: Column, steps: int = 60, near: float = 1e-4) -> Column:
    """The column form of ``invert``: the same bisection between the outer knots.

    The curve is monotone, so the piece that holds y follows from the knots' values, and a middle outside that piece is
    judged by its place alone; the accumulator holds the piece, so each step is a few multiplications.
    """
    n, at = F.size(knots), F.element_at
    k = F.least(F.greatest(F.size(F.filter(F.sequence(F.lit(1), n), lambda i: at(coeffs, 2 * i - 1) < y)), F.lit(1)), n - 1)
    piece = {"p0": at(knots, k), "p1": at(knots, k + 1), "v0": at(coeffs, 2 * k - 1), "s0": at(coeffs, 2 * k), "v1": at(coeffs, 2 * k + 1), "s1": at(coeffs, 2 * k + 2), "y": y}
    ends = {"low": at(knots, F.lit(1)), "high": at(knots, n)}
    packed = lambda parts: F.struct(*(c.alias(name) for name, c in parts.items()))

    def step(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]
        mid = (low + high) / 2
        w = acc["p1"] - acc["p0"]
        got = F.when(mid <= acc["p0"], F.lit(float("-inf"))).when(mid >= acc["p1"], F.lit(float("inf"))).otherwise(_hermite((mid - acc["p0"]) / w, w, acc["v0"], acc["s0"], acc["v1"], acc["s1"]))
        hit = F.abs(got - acc["y"]) < near
        held = {name: acc[name] for name in piece}
        return F.when(low == high, acc).otherwise(packed({**held, "low": F.when(hit | (got < acc["y"]), mid).otherwise(low), "high": F.when(hit | (got >= acc["y"]), mid).otherwise(high)}))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), packed({**piece, **ends}), step, lambda acc: (acc["low"] + acc["high"]) / 2)
    slope = at(coeffs, F.lit(2))
    line = F.when(slope != 0, at(knots, F.lit(1)) + (y - at(coeffs, F.lit(1))) / slope).otherwise(at(knots, F.lit(1)))
    inside = F.when(y <= at(coeffs, F.lit(1)), ends["low"]).when(y >= at(coeffs, 2 * n - 1), ends["high"]).otherwise(found)
    return F.when(n == 1, line).when(n > 1, inside)


def invert(curve: Curve, y, steps: int = 60, near: float = 1e-4) -> np.ndarray:
    """x with the curve's value y, by bisection between the outer knots, which also bound the answer. A line is solved outright."""
    knots, c = curve
    y = np.asarray(y, float)
    if len(knots) == 1:
        return knots[0] + (y - c[0, 0]) / c[0, 1] if c[0, 1] else np.full(len(y), knots[0])
    low, high = np.full(len(y), knots[0]), np.full(len(y), knots[-1])
    below, above = y <= evaluate(curve, low), y >= evaluate(curve, high)
    for _ in range(steps):
        mid = (low + high) / 2
        got = evaluate(curve, mid)
        hit, less = np.abs(got - y) < near, got < y
        low, high = np.where(hit | less, mid, low), np.where(hit | ~less, mid, high)
        if hit.all():
            break
    return np.where(below, knots[0], np.where(above, knots[-1], (low + high) / 2))
