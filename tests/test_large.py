"""Queries that large inputs once stopped: how they go about many groups and long ladders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import curves, ions, ladders
from massloom.operators import calibrate
from massloom.operators.annotate import annotate
from massloom.plans import peptides as peptide_plans
from massloom.sources import sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("prop", ["rt", "im"])
def test_lines_of_small_groups_are_one_aggregate(spark, prop):
    rng = np.random.default_rng(3)
    sizes = {"a": 9, "b": 10, "c": 11, "d": 99, "e": 40, None: 12}
    rows = [(g, float(k), float(x) + 1e3, 2.0 if g == "e" else float(y)) for g, n in sizes.items() for k, (x, y) in enumerate(rng.normal(50, 9, (n, 2)))]
    schema = "g string, evalue double, exp double, pred double"
    small = calibrate.fit_curves(spark.createDataFrame(rows, schema), ("g",), prop)
    assert "Pandas" not in plan(small)
    big = [("f", float(k), float(k), float(k)) for k in range(150)]
    for fitted in (small, calibrate.fit_curves(spark.createDataFrame(rows + big, schema), ("g",), prop)):
        found = {r["g"]: r for r in fitted.collect()}
        assert set(found) - {"f"} == set(sizes)
        for g, n in sizes.items():
            pairs = [(p, e) if prop == "rt" else (e, p) for h, _, e, p in rows if h == g]
            r = found[g]
            assert r["n"] == n and r["kind"] == ("none" if n < (10 if prop == "rt" else 11) else "linear")
            if r["kind"] == "linear":
                want = curves.line(*zip(*pairs, strict=True))
                assert r["knots"] == [0.0] and np.allclose(r["coeffs"], want[1].ravel(), rtol=1e-8, atol=1e-8)
            else:
                assert r["knots"] == [] and r["coeffs"] == []
    assert found["f"]["kind"] == "spline" and found["f"]["n"] == 150


def test_pick_joins_the_curves_of_a_run_once(spark):
    line = lambda run, group, slope: (run, group, "linear", [0.0], [0.0, slope])
    fitted = spark.createDataFrame([line("r", "A", 2.0), line("r", "B", 4.0), line("r", "others", 1.0), line("s", "A", 1.0), ("s", "others", "none", [], [])], "run string, mass_group string, kind string, knots array<double>, coeffs array<double>")
    psms = [(1, "r", 8.0, 3.5, ["A", "B"]), (2, "r", 8.0, 3.0, ["B"]), (3, "r", 8.0, 3.0, None), (4, "r", 8.0, 3.0, ["C"]), (5, "s", 8.0, 3.0, []), (6, "s", 8.0, 5e3, ["A"]), (7, None, 8.0, 3.0, ["A"]), (8, "r", None, 3.0, ["A"]), (9, "r", 8.0, 5e3, ["C", None])]
    rows = spark.createDataFrame(psms, "psm_id long, run string, exp_rt double, pred_rt double, tried array<string>")
    found = calibrate.adaptive_pick_arrays(rows, "tried", fitted)
    want = {1: (0.5, 4.0), 2: (1.0, 2.0), 3: (5.0, 8.0), 4: (5.0, 8.0), 5: (0.0, None), 6: (1000.0, None), 7: (0.0, None), 8: (0.0, None), 9: (4992.0, 8.0)}
    assert {r["psm_id"]: (r["delta"], r["calibrated"]) for r in found.collect()} == want
    assert plan(found).count("Join ") + plan(found).count("Join(") <= 2  # the plan and its final form
    groups = rows.select("psm_id", F.explode("tried").alias("mass_group"))
    assert {r["psm_id"]: (r["delta"], r["calibrated"]) for r in calibrate.adaptive_pick(rows.drop("tried"), groups, fitted).collect()} == want


def test_calibration_files_are_few_and_whole(spark, tmp_path):
    """300 groups, some with odd names, once 600 folders: few files, each group together in one of each part, the lines of a grid by x."""
    odd = ["a\tb", "line\nbreak", "\r", "50%25", "%00", "", "x=y/z"]
    names = [*odd, *(f"g{k}" for k in range(293))]
    points = spark.createDataFrame([(g, k, float(x), x / 3) for k, g in enumerate(names) for x in range(20, 0, -1)], "run string, charge int, x double, y double")
    anchors = spark.createDataFrame([(g, k, p) for k, g in enumerate([*names, "none"]) for p in ("P\tEP", "AAA", "AAA")], "run string, charge int, peptide string")
    path = str(tmp_path / "out")
    sinks.calibration_files(points, anchors, ("run", "charge"), path)
    files = list(tmp_path.rglob("part-*"))
    assert {f.parent.name for f in files} == {"part=table", "part=peptides"} and len(files) <= 16
    seen = {}
    for f in files:
        lines = [line.split("\t") for line in f.read_text().split("\n")[:-1]]
        starts = [i for i, c in enumerate(lines) if i == 0 or c[:2] != lines[i - 1][:2]]
        for i, j in zip(starts, [*starts[1:], len(lines)], strict=True):
            key = (f.parent.name, *lines[i][:2])
            assert key not in seen
            seen[key] = j - i
            if f.parent.name == "part=table":
                assert [float(c[3]) for c in lines[i:j]] == list(range(1, 21))
    assert sorted(seen.values()) == [3] * 300 + [20] * 300
    table, used = sinks.read_calibration(spark, path, ("run", "charge"))
    assert sorted(map(tuple, table.collect())) == sorted((g, str(k), x / 3, float(x)) for k, g in enumerate(names) for x in range(1, 21))
    assert sorted(map(tuple, used.collect())) == sorted((g, str(k), p) for k, g in enumerate(names) for p in ("AAA", "AAA", "P\tEP"))


PEPTIDES = ["PEPTWIDEK", "CWMK", "CCMMMK", "AAA", "AA", "G", "", "MKKKMMMMMKKKKKKKKKKK", "ACDEFGHIKLMNPQRSTVWY" * 15, "WWWWK"]


def test_internal_sums_equal_the_ions(spark):
    """From letters and from arrays of masses, without a row for an ion and without a shuffle."""
    rows = spark.createDataFrame([(p,) for p in PEPTIDES], "peptide string")
    moved = rows.withColumn("residues", F.transform(ions.masses(F.col("peptide")), lambda m: m + 0.123456))
    for table, residues in ((rows.withColumn("residues", ions.masses(F.col("peptide"))), "peptide"), (moved, "residues")):
        for losses in (("H2O", "NH3"), ()):
            want = {tuple(r) for r in ions.internal(table, losses).groupBy("peptide", "ion", "loss").agg(F.count("*"), F.sum(F.floor(F.col("mz") * 10000 + 0.5))).collect()}
            found = ladders.internal_sums(table, losses, residues=residues)
            got = found.collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want) == 6 * 2 * (len(losses) + 1)
    assert "Exchange" not in plan(found) and ladders.internal_sums(rows.limit(0)).count() == 0
    assert ladders.internal_sums(spark.createDataFrame([(None,), ("XXXXX",)], "peptide string")).select("total").distinct().collect() == [(None,)]


def test_internal_ions_query_makes_no_row_of_an_ion(spark, sf):
    made = plan(peptide_plans.QUERIES["internal_ions"](spark, sf))
    assert "MapInArrow" in made and made.count("Generate explode") <= 2 * 2  # the peptides of a text and the kinds of a peptide


@pytest.mark.parametrize("activation", ["HCD", "ETD"])
def test_possible_ion_sums_equal_the_ions(spark, activation, monkeypatch):
    rows = [(p, d, 2 + len(p) % 3) for p, d in zip(PEPTIDES, [[79.9663], [], [57.0215, 15.9949], [79.96651], [79.96649], [15.9951], [], [15.9949, 79.9663, 15.9949], [57.0215], [57.0214]], strict=True)]
    table = spark.createDataFrame(rows, "peptide string, deltas array<double>, charge int").withColumn("residues", ions.masses(F.col("peptide")))
    given = peptide_plans.dictionary(spark)
    dictionary = given.unionByName(given.filter("number = 3 or start = 4")).unionByName(given.limit(1).withColumn("number", F.lit(0)))
    want = {tuple(r) for r in ions.possible_ions(table, dictionary, activation=activation).groupBy("peptide", "ion").agg(F.count("*"), F.sum(F.floor(F.col("mz") * 10000 + 0.5))).collect()}
    for residues in ("peptide", "residues"):
        found = ladders.possible_ion_sums(table, dictionary, activation=activation, residues=residues)
        assert {tuple(r) for r in found.collect()} == want and len(want) > 40
        assert "Exchange" not in plan(found)
    assert ladders.possible_ion_sums(table.limit(0), dictionary).count() == 0 and ladders.possible_ion_sums(table, dictionary.limit(0)).count() == 0
    assert ladders.possible_ion_sums(table.withColumn("deltas", F.lit(None).cast("array<double>")), dictionary).count() > 40
    monkeypatch.setattr(ladders, "MOST_ENTRIES", 10)
    assert {tuple(r) for r in ladders.possible_ion_sums(table, dictionary, activation=activation).collect()} == want


def test_dictionary_query_makes_no_row_of_an_ion(spark, sf):
    made = plan(peptide_plans.QUERIES["theoretical_dictionary_filter"](spark, sf))
    assert "MapInArrow" in made and "Join" not in made


@pytest.mark.parametrize("tolerance, unit", [(15.0, "da"), (200.0, "da"), (20_000.0, "ppm")])
def test_ladder_names_equal_the_join(spark, tolerance, unit):
    """Single and several hits, types by priority, peptides without a ladder, without m/z and with a null among them."""
    ends = [None, [], [500.0], [100.0, None, 700.0, 1e6], [250.0, 251.0, 252.0], *([40.0 + 31 * k for k in range(30)] for _ in range(5))]
    table = spark.createDataFrame(list(zip(PEPTIDES, ends, strict=True)), "peptide string, asked array<double>").withColumn("residues", ions.masses(F.col("peptide")))
    theory = ions.ladder(table, ["b", "y"], [1]).select("peptide", "ion", F.concat("ion", F.col("number").cast("string")).alias("name"), "mz")
    rows = table.select("peptide", F.posexplode("asked").alias("q", "mz"))
    want = sorted(map(tuple, annotate(rows.filter("mz is not null"), theory, ["y", "b"], tolerance=tolerance, unit=unit, by=("peptide", "q"), keys=["peptide"], width=500.0).select("peptide", "q", "names").collect()))
    for residues in ("peptide", "residues"):
        found = ladders.ladder_names(table, F.col("asked"), ["y", "b"], tolerance=tolerance, unit=unit, residues=residues)
        got = sorted(map(tuple, found.select("peptide", F.posexplode("names")).collect()))
        assert (PEPTIDES[3], 1, "unknown") in got
        assert [r for r in got if not (r[0] == PEPTIDES[3] and r[1] == 1)] == want and len({r[2] for r in got}) > 9
        assert found.count() == len(PEPTIDES) and "Exchange" not in plan(found)
    assert any(";" in r[2] for r in want) == (tolerance == 200.0)


def test_annotation_query_joins_no_ladder(spark, sf):
    assert "Join" not in plan(peptide_plans.QUERIES["ion_annotation"](spark, sf))
