"""Grouped curve fits over all runs, and their use on whole tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions import curves
from massloom.operators import anchors as anchor_rules
from massloom.operators.ranks import first_rows
from massloom.sources.store import written

#: Anchors of a group that take part in a fit at most (see anchors.top_n), and steps of a calibration grid.
MOST_ANCHORS, GRID = {"rt": anchor_rules.MOST_ANCHORS, "im": 1000}, 10_000
CAP_RT, CAP_IM = 1000.0, 0.5
#: Anchors of a spline at least, and groups of splines that are broadcast at most.
SPLINE, MOST_HINTED = 100, 10_000


def fit_anchors(anchors: DataFrame, by: tuple[str, ...], prop: str = "rt", *, order: str = "evalue") -> DataFrame:
    """The anchors that take part in the fit of their group: at most MOST_ANCHORS of each, cut before they are shuffled."""
    return first_rows(anchors, MOST_ANCHORS[prop], by, (order, "exp", "pred"))


def fit_curves(anchors: DataFrame, by: tuple[str, ...], prop: str = "rt", *, order: str = "evalue") -> DataFrame:
    """One curve per group: by, kind (none, linear, spline), n, knots, coeffs.

    anchors: by, exp, pred and ``order``. Below 10 anchors there is no curve (mobility: 10 or fewer), below 100 a line,
    else a monotone spline. Retention time is fitted from predicted to experimental and used inverted, mobility from
    experimental to predicted. Lines are moments, so any number of small groups is one aggregate, which is written; only
    the groups of a spline go to Python, each cut to MOST_ANCHORS before it reaches its task.
    """
    kinds = [anchors.schema[b] for b in by]
    schema = T.StructType([*kinds, T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("knots", T.ArrayType(T.DoubleType())), T.StructField("coeffs", T.ArrayType(T.DoubleType()))])
    groups = written(_moments(anchors, by, *(("pred", "exp") if prop == "rt" else ("exp", "pred"))), "groups")
    few = _lines(groups.filter(F.col("n") < SPLINE), by, 11 if prop == "im" else 10)
    many = groups.filter(F.col("n") >= SPLINE).select(*(F.col(b).alias(f"__of_{b}") for b in by))
    known = many.limit(MOST_HINTED + 1).count()
    if not known:
        return few

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["exp", "pred"], kind="stable")
        x, y = (rows["pred"], rows["exp"]) if prop == "rt" else (rows["exp"], rows["pred"])
        kind, curve = "spline", curves.fit(x, y)
        if curve is None:
            kind, curve = "none", (np.empty(0), np.empty((0, 2)))
        return pd.DataFrame([(*key, kind, len(rows), curve[0].tolist(), curve[1].ravel().tolist())], columns=schema.names)

    same = reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"__of_{b}")) for b in by))
    large = anchors.join(F.broadcast(many) if known <= MOST_HINTED else many, same, "left_semi")
    return few.unionByName(fit_anchors(large, by, prop, order=order).select(*by, "exp", "pred").groupBy(*by).applyInPandas(one, schema))


def _moments(anchors: DataFrame, by: tuple[str, ...], x: str, y: str) -> DataFrame:
    """by, n and the central moments of x and y over the rows that have both."""
    px, py = F.when(F.col(y).isNotNull(), F.col(x)).cast("double"), F.when(F.col(x).isNotNull(), F.col(y)).cast("double")
    return anchors.groupBy(*by).agg(F.count("*").alias("n"), F.avg(px).alias("mx"), F.avg(py).alias("my"), F.var_pop(px).alias("var"), F.covar_pop(px, py).alias("cov"))


def _lines(groups: DataFrame, by: tuple[str, ...], fewest: int) -> DataFrame:
    """The least-squares line of each group's moments as a curve of one knot; flat where x does not vary."""
    slope = F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(0.0)
    some, none = F.col("n") >= fewest, F.array().cast("array<double>")
    coeffs = F.array(F.col("my") - slope * F.col("mx"), slope)
    return groups.select(*by, F.when(some, "linear").otherwise("none").alias("kind"), "n", F.when(some, F.array(F.lit(0.0))).otherwise(none).alias("knots"), F.when(some, coeffs).otherwise(none).alias("coeffs"))


def _use(prop: str, value: str) -> Column:
    if prop == "rt":
        return curves.inverse_at(F.col(value).cast("double"), F.col("knots"), F.col("coeffs"))
    return curves.value_at(F.col(value), F.col("knots"), F.col("coeffs"))


def calibrated(rows: DataFrame, fitted: DataFrame, by: tuple[str, ...], prop: str = "rt", measured: str = "exp_rt") -> DataFrame:
    """Adds ``calibrated``: the prediction that the group's curve gives for the measured value; null without a curve.

    Curves are one row per group; Spark picks a broadcast or a shuffle by their size.
    """
    known = fitted.filter("kind <> 'none'").select(*by, "knots", "coeffs")
    hit = rows.join(known, list(by)).withColumn("calibrated", _use(prop, measured)).drop("knots", "coeffs")
    miss = rows.join(known.select(*by), list(by), "left_anti").withColumn("calibrated", F.lit(None).cast("double"))
    return hit.unionByName(miss)


def pick(matched: DataFrame, *, cap: float = CAP_RT, predicted: str = "pred_rt", key: str = "psm_id") -> DataFrame:
    """Over all curves that a PSM matches, the smallest delta below ``cap`` and its calibrated value.

    Where no curve comes below ``cap``, delta is ``cap`` and there is no calibrated value; without any curve delta is 0.
    """
    away = F.abs(F.col("calibrated") - F.col(predicted))
    near = F.when(away < cap, F.struct(away.alias("delta"), F.col("calibrated").alias("calibrated")))  # null without a curve
    found = matched.groupBy(key).agg(F.min(near).alias("best"), F.count("calibrated").alias("n"))
    delta = F.when(F.col("n") > 0, F.coalesce("best.delta", F.lit(cap))).otherwise(0.0)
    return found.select(key, delta.alias("delta"), F.col("best.calibrated").alias("calibrated"))


def adaptive_pick(psms: DataFrame, groups: DataFrame, fitted: DataFrame, *, run: str = "run", group: str = "mass_group", others: str = "others", measured: str = "exp_rt", predicted: str = "pred_rt", key: str = "psm_id") -> DataFrame:
    """key, delta and calibrated of each PSM, over the curves of the mass groups that it matches.

    groups: key and group, a row for each group that a PSM matches (see anchors.mass_groups), perhaps none. A PSM that
    matches no group with a curve in its run falls back to the curve of ``others``, whatever the delta; in a run
    without that curve delta is 0.
    """
    held = groups.groupBy(key).agg(F.collect_set(group).alias("__tried"))
    return adaptive_pick_arrays(psms.join(held, key, "left"), "__tried", fitted, run=run, group=group, others=others, measured=measured, predicted=predicted, key=key)


def adaptive_pick_arrays(psms: DataFrame, tried: str, fitted: DataFrame, *, run: str = "run", group: str = "mass_group", others: str = "others", measured: str = "exp_rt", predicted: str = "pred_rt", key: str = "psm_id", cap: float = CAP_RT) -> DataFrame:
    """The same for PSMs whose groups are an array column, perhaps null: one join with the curves of the run and no shuffle by key.

    The curves of a run are one row; each PSM is evaluated on those that count for it and no others.
    """
    held = fitted.filter("kind <> 'none'").groupBy(run).agg(F.collect_list(F.struct(F.col(group).alias("of"), "knots", "coeffs")).alias("__curves"))
    rows = psms.select(key, run, F.col(measured).alias("__at"), F.col(predicted).alias("__pred"), F.col(tried).alias("__tried")).join(held, run, "left")
    rows = rows.withColumn("__own", F.filter("__curves", lambda c: F.array_contains("__tried", c["of"])))
    own = F.coalesce(F.size("__own") > 0, F.lit(False))
    used = F.when(own, F.col("__own")).otherwise(F.slice(F.filter("__curves", lambda c: c["of"] == others), 1, 1))
    values = F.filter(F.transform(used, lambda c: curves.inverse_at(F.col("__at").cast("double"), c["knots"], c["coeffs"])), lambda v: v.isNotNull())
    rows = rows.select(key, "__pred", own.alias("__matched"), values.alias("__values"))
    away = lambda v: F.abs(v - F.col("__pred"))
    best = F.array_min(F.transform("__values", lambda v: F.when(away(v) < cap, F.struct(away(v).alias("delta"), v.alias("calibrated")))))
    rows = rows.withColumns({"__best": best, "__first": F.get("__values", F.lit(0))})
    matched = F.when(F.size("__values") > 0, F.coalesce("__best.delta", F.lit(cap))).otherwise(0.0)
    delta = F.when(F.col("__matched"), matched).otherwise(F.coalesce(away(F.col("__first")), F.lit(0.0)))
    return rows.select(key, delta.alias("delta"), F.when(F.col("__matched"), F.col("__best.calibrated")).otherwise(F.col("__first")).alias("calibrated"))


def mobility_delta(matched: DataFrame, *, predicted: str = "pred_im", key: str = "psm_id") -> DataFrame:
    """min |f(measured) - predicted| * 1000, at most 500; 500 without a curve."""
    away = F.abs(F.col("calibrated") - F.col(predicted))
    delta = F.when(away < CAP_IM, away) * 1000
    return matched.groupBy(key).agg(F.coalesce(F.min(delta), F.lit(CAP_IM * 1000)).alias("delta_im_loess"))


def grid(psms: DataFrame, fitted: DataFrame, by: tuple[str, ...], prop: str = "rt", steps: int = GRID, measured: str = "exp_rt") -> DataFrame:
    """by, x (``steps`` equal steps over the run's measured range) and y, the calibrated value: the table for inverse lookups."""
    ends = psms.groupBy("run").agg(F.min(measured).alias("low"), F.max(measured).alias("high"))
    rows = fitted.filter("kind <> 'none'").join(ends, "run").select(*by, "knots", "coeffs", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (steps - 1)
    return rows.withColumn("x", x).select(*by, "i", "x", _use(prop, "x").alias("y"))


def samples(anchors: DataFrame, fitted: DataFrame, by: tuple[str, ...], n: int = 1000) -> DataFrame:
    """n points of each curve between its own first and last anchor."""
    ends = anchors.groupBy(*by).agg(F.min("pred").alias("low"), F.max("pred").alias("high"))
    rows = fitted.filter("kind <> 'none'").join(ends, list(by)).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (n - 1)
    return rows.withColumn("x", x).select(*by, "i", "x", curves.value_at(F.col("x"), F.col("knots"), F.col("coeffs")).alias("y"))


def residuals(anchors: DataFrame, by: tuple[str, ...] = ("model",), digits: int = 2) -> DataFrame:
    """|measured - fitted| of each anchor of each model, values rounded; 1e6 where nothing can be fitted."""
    rounded = anchors.withColumns({"exp": F.round("exp", digits), "pred": F.round("pred", digits)})
    fitted = fit_curves(rounded, by, "rt", order="exp")
    joined = rounded.join(fitted.select(*by, "kind", "knots", "coeffs"), list(by), "left")
    value = curves.value_at(F.col("pred"), F.col("knots"), F.col("coeffs"))
    return joined.withColumn("residual", F.when(F.col("kind") == "none", F.lit(1e6)).otherwise(F.abs(F.col("exp") - value))).drop("kind", "knots", "coeffs")
