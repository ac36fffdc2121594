"""Curve pick and merging of close fragments at their edges."""

from massloom.operators import calibrate, library


def test_pick_is_strict_and_null_aware(spark):
    rows = spark.createDataFrame([(1, 5.0, 7.0), (1, 9.0, 7.0), (2, None, 7.0), (3, 2000.0, 7.0), (3, None, 7.0), (4, 1007.0, 7.0), (5, 7.0, 7.0), (5, 3000.0, 7.0)], "psm_id long, calibrated double, pred_rt double")
    got = {r["psm_id"]: (r["delta"], r["calibrated"]) for r in calibrate.pick(rows).collect()}
    assert got == {1: (2.0, 5.0), 2: (0.0, None), 3: (1000.0, None), 4: (1000.0, None), 5: (0.0, 7.0)}


def test_fallback_to_the_others(spark):
    fitted = spark.createDataFrame([("r", "A", "none", [], []), ("s", "A", "none", [], []), ("s", "others", "none", [], [])], "run string, mass_group string, kind string, knots array<double>, coeffs array<double>")
    anchors = spark.createDataFrame([("r", g, float(k), k * f, float(k)) for g, f in (("B", 1.0), ("others", 2.0)) for k in range(1, 41)], "run string, mass_group string, evalue double, exp double, pred double")
    fitted = fitted.unionByName(calibrate.fit_curves(anchors, ("run", "mass_group")).select(*fitted.columns))
    # Fitted: exp = pred for B, exp = 2 pred for the others.
    psms = spark.createDataFrame([(1, "r", 10.0, 11.0), (2, "r", 10.0, 11.0), (3, "r", 10.0, 11.0), (4, "s", 10.0, 11.0), (5, "t", 10.0, 11.0), (6, "r", 10.0, 5e6)], "psm_id long, run string, exp_rt double, pred_rt double")
    groups = spark.createDataFrame([(1, "B"), (1, "B"), (1, "A"), (2, "A"), (4, "A"), (6, "C"), (9, "B")], "psm_id long, mass_group string")
    got = {r["psm_id"]: (round(r["delta"], 6), r["calibrated"] and round(r["calibrated"], 6)) for r in calibrate.adaptive_pick(psms, groups, fitted).collect()}
    # 1 has B; 2's group has no curve, 3 has no group: the others' curve, beyond the cap too; 4 and 5 have no curve in their run.
    assert got == {1: (1.0, 10.0), 2: (6.0, 5.0), 3: (6.0, 5.0), 4: (0.0, None), 5: (0.0, None), 6: (4999995.0, 5.0)}


def test_close_fragments_merge_one_after_the_other(spark):
    step = 9e-6
    rows = [(1, k, 100 + k * step, 1.0, "b", 2) for k in range(4)] + [(2, 0, 5.0, 1.0, "y", 1), (2, 1, 5.0, 2.0, "b", 2), (2, 2, 5.0, 4.0, "z", None), (3, 0, 7.0, 1.0, "u", None), (3, 1, 7.0, 1.0, "v", None)]
    frags = spark.createDataFrame(rows, "psm long, pos long, mz double, intensity double, ion_type string, priority int")
    got = sorted(tuple(r) for r in library.merge_close(frags).collect())
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(1, 2.0, "b", 2), (1, 2.0, "b", 2), (2, 7.0, "y", 3), (3, 2.0, "v", 2)]
    assert abs(got[0][1] - (100 + step / 2)) < 1e-9 and abs(got[1][1] - (100 + 2.5 * step)) < 1e-9
    assert library.merge_close(frags.limit(0)).count() == 0
