"""The dictionary index against a plain filter of every ion and peptide."""

import pytest
from pyspark.sql import functions as F

from massloom.functions import ions

FIELDS = "ion string, number int, charge int, start int, extent int, residue string, loss string, lost double, needs double, mass double"
ENTRIES = [
    *(("by"[k % 2], n, z, None, None, None, loss, lost, needs, None) for k in range(2) for n in range(1, 12) for z in (1, 2) for loss, lost, needs in (("", 0.0, None), ("H3PO4", 97.976896, 79.9663), ("CH4SO", 63.998285, 15.9949))),
    *(("int", None, 1, s, e, None, "", 0.0, None, None) for s in range(1, 9) for e in range(1, 9)),
    *(("p", None, z, None, None, None, "", 0.0, None, None) for z in (0, 1, 2)),
    ("imm", None, 1, None, None, "W", "IWA", 0.0, None, 159.09), ("imm", None, 1, None, None, "C", "ICCAM", 0.0, 57.0215, 133.04), ("a", 3, 1, None, None, None, "", 0.0, None, None),
]
PEPTIDES = [("PEPTWIDEK", [79.9663]), ("CWMK", []), ("CCMMMK", [57.0215, 15.9949]), ("AA", [79.96649]), ("AAA", [79.96651]), ("G", []), ("MKKKMMMMMKKKKKKKKKKK", [15.99509, 15.9951, 79.9659])]


def possible(entry, letters, deltas, electron):
    ion, number, z, start, extent, residue, _, _, needs, _ = entry
    n = len(letters)
    if ion in "bya" and number >= n:
        return False
    if ion == "p" and z != 0 and not electron:
        return False
    if ion == "int" and not (2 <= start < n and start + extent - 1 < n):
        return False
    if ion == "imm" and residue not in letters:
        return False
    return needs is None or any(abs(d - needs) <= 0.0002 for d in deltas)


def mz(entry, letters):
    ion, number, z, start, extent, _, _, lost, _, mass = entry
    part = lambda a, b: sum(ions.RESIDUES[c] for c in letters[a:b])
    if ion == "imm":
        return mass
    z = (z or 3) if ion == "p" else z
    m = {"p": lambda: part(0, None) + ions.WATER, "int": lambda: part(start - 1, start + extent - 1), "y": lambda: part(len(letters) - number, None) + ions.WATER, "b": lambda: part(0, number), "a": lambda: part(0, number) - ions.CARBONYL}[ion]()
    return (m - lost + z * ions.PROTON) / z


@pytest.mark.parametrize("activation", ["HCD", "CID", "ETD"])
def test_possible_ions(spark, activation):
    rows = spark.createDataFrame([(p, d, 3) for p, d in PEPTIDES], "peptide string, deltas array<double>, charge int").withColumn("residues", ions.masses(F.col("peptide")))
    table = spark.createDataFrame(ENTRIES, FIELDS)
    found = ions.possible_ions(rows, table, activation=activation)
    want = sorted((p, e[0], e[1] or 0, e[3] or 0, e[4] or 0, e[6], round(mz(e, p), 6)) for p, d in PEPTIDES for e in ENTRIES if possible(e, p, d, activation == "ETD"))
    got = sorted((r["peptide"], r["ion"], r["number"] or 0, r["start"] or 0, r["extent"] or 0, r["loss"], round(r["mz"], 6)) for r in found.collect())
    assert got == want and len(got) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert ions.possible_ions(rows.limit(0), table).count() == 0 and ions.possible_ions(rows, table.limit(0)).count() == 0


def test_ladder_sums_equal_the_ladder(spark):
    rows = spark.createDataFrame([(p,) for p, _ in PEPTIDES], "peptide string").withColumn("residues", ions.masses(F.col("peptide")))
    kinds = (["b", "c", "y", "z_dot"], [1, 3], (0, 2), ("H2O", "NH3"))
    for by in (("ion", "charge"), ("loss",), ("ion", "charge", "isotope", "loss")):
        want = {tuple(r[:-2]): (r["n"], round(r["total"], 4)) for r in ions.ladder(rows, *kinds).groupBy("peptide", *by).agg(F.count("*").alias("n"), F.sum("mz").alias("total")).collect()}
        got = {tuple(r[:-2]): (r["n"], round(r["total"], 4)) for r in ions.ladder_sums(rows, lambda m: m, by, *kinds).collect()}
        assert got == want and len(got) >= 12
