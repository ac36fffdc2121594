"""Densities against the direct sum, weighted moments, run quality of large values, and transfers of predictions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from massloom.operators import anchors, library
from massloom.streaming import run_qc


def test_density_is_the_direct_sum(spark):
    rng = random.Random(8)
    values = {"a": [rng.gauss(0, 3) for _ in range(300)] + [1e4], "b": [5.0], "c": [1e6 + rng.random() for _ in range(50)], "d": [2.0] * 9}
    weights = {k: [rng.randint(1, 4) for _ in v] for k, v in values.items()}
    members = spark.createDataFrame([(k, v, w) for k in values for v, w in zip(values[k], weights[k], strict=True)] + [("a", None, 3)], "bin string, pred_rt double, weight int")
    asked = [(i, k, x) for i, (k, x) in enumerate([("a", v) for v in (-40.0, -3.0, 0.0, 0.123456, 1e4, 1e7)] + [("b", 5.0), ("b", 6.0), ("c", 1e6 + 0.5), ("d", 2.0), ("d", 2.5), ("none", 1.0), ("a", None), (None, 1.0)])]
    psms = spark.createDataFrame(asked, "psm_id long, bin string, pred_rt double")
    stats = anchors.bin_stats(members, ("bin",))
    known = {r["bin"]: r for r in stats.collect()}
    for bandwidth in (None, 0.7):
        got = {r["psm_id"]: r["probability"] for r in anchors.density(psms, members, stats, ("bin",), bandwidth=bandwidth).collect()}
        assert len(got) == len(asked)
        for i, k, x in asked:
            want = 0.0
            if k in values and x is not None:
                s = known[k]
                spread = min(s["sd"], s["iqr"] / 1.34)
                h = bandwidth or 1.36374 * (1.0 if spread > 1e30 else spread) * s["n"] ** -0.2
                want = sum(w * math.exp(-0.5 * ((x - v) / h) ** 2) for v, w in zip(values[k], weights[k], strict=True)) / (s["n"] * h * math.sqrt(2 * math.pi))
            assert got[i] == pytest.approx(want, abs=1e-9 if k == "c" else 1e-11), (i, k, x)


def test_bin_stats_weigh_rows(spark):
    rows = [("a", 1e9 + v, w) for v, w in ((0.0, 3), (1.0, 1), (2.5, 2), (7.0, 1))] + [("b", 4.0, 1), ("c", 4.0, 5), ("d", None, 2)]
    got = {r["bin"]: r for r in anchors.bin_stats(spark.createDataFrame(rows, "bin string, pred_rt double, weight int"), ("bin",)).collect()}
    copies = [1e9 + v for v, w in ((0.0, 3), (1.0, 1), (2.5, 2), (7.0, 1)) for _ in range(w)]
    assert got["a"]["n"] == 7 and got["a"]["mean"] == pytest.approx(statistics.mean(copies)) and got["a"]["sd"] == pytest.approx(statistics.stdev(copies), rel=1e-9)
    assert [(got[k]["n"], got[k]["sd"]) for k in "bcd"] == [(1, anchors.FLT_MAX), (5, anchors.FLT_MAX), (2, anchors.FLT_MAX)]


def test_run_quality_of_large_values(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{k % 2}", 1e9 + rng.gauss(0, 1)) for k in range(4000)] + [("r2", 5.0), ("r3", None)]
    df = spark.createDataFrame(rows, "run string, value double")
    df.repartition(9).write.parquet(f"{tmp_path}/scored")
    batch = {r["run"]: r for r in run_qc.summary(run_qc.stream_moments(df, "value")).collect()}
    stream = {r["run"]: r for r in run_qc.run_available(spark, f"{tmp_path}/scored", df.schema, "value").collect()}
    assert batch.keys() == stream.keys() == {"r0", "r1", "r2"}
    for run in ("r0", "r1"):
        values = [v for r, v in rows if r == run]
        for found in (batch[run], stream[run]):
            assert found["n"] == 2000 and found["mean"] == pytest.approx(statistics.fmean(values), rel=1e-14)
            assert found["sd"] == pytest.approx(statistics.stdev(values), rel=1e-6)
    assert batch["r2"]["sd"] is None and stream["r2"]["sd"] is None


FRAGMENT = "array<struct<mz:double,intensity:double,ion_type:string,frag_num:int,charge:int>>"


def test_transfer_moves_fragments_and_tells_errors(spark):
    frags = [(100.0, 1.0, "b", 1, 1), (200.0, 2.0, "y", 2, 2), (300.0, 3.0, "b", 3, 1), (400.0, 4.0, "unknown", 0, 1), (500.0, 5.0, "y", 3, 1)]
    predictions = spark.createDataFrame([("own", 7.0, frags), ("other", 9.0, frags), ("bare", 3.0, [])], f"precursor string, rt double, fragments {FRAGMENT}")
    new, old = [1.0, 10.0, 20.0, 30.0, 2.0], [0.5, 0.0, 0.0, 5.0, 0.0]
    wanted = [("own", "other", new, old, True), ("w1", "other", new, old, True), ("w2", "nothing", new, old, False), ("w3", None, new, old, True), ("w4", "bare", new, old, True)]
    wanted = spark.createDataFrame(wanted, "precursor string, translated string, masses array<double>, translated_masses array<double>, eligible boolean")
    rows = library.transfer(wanted, predictions)
    got = {r["precursor"]: r for r in rows.collect()}
    assert {k: r["source"] for k, r in got.items()} == {"own": "exact", "w1": "translated", "w2": "skipped", "w3": "missing", "w4": "translated"}
    assert [f["mz"] for f in got["own"]["fragments"]] == [100.0, 200.0, 300.0, 400.0, 500.0]
    # The peptide has three residues: b1 holds the terminus and one of them, y2 two and the other terminus, b3 and y3 all.
    assert [f["mz"] for f in got["w1"]["fragments"]] == [100 + 10.5, 200 + 47 / 2, 300 + 57.5, 400.0, 500 + 57.5]
    assert [f["intensity"] for f in got["w1"]["fragments"]] == [1.0, 2.0, 3.0, 4.0, 5.0] and got["w1"]["rt"] == 9.0
    assert (got["w2"]["rt"], got["w2"]["fragments"], got["w3"]["rt"], got["w3"]["fragments"], got["w4"]["fragments"]) == (0.0, [], None, None, [])
    assert [r["precursor"] for r in library.missing(rows).collect()] == ["w3"]
    with pytest.raises(Exception, match="no prediction of w3"):
        library.transfer(wanted, predictions, strict=True).collect()
    assert library.transfer(wanted.filter(F.col("precursor") != "w3"), predictions, strict=True).count() == 4
