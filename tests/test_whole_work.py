"""Queries work on all that their survey entry names."""

import pytest
from pyspark.sql import functions as F

from massloom.plans import files


@pytest.mark.parametrize("name", ["hermite_ls_fit", "monotone_repair", "loess_fallback"])
def test_fit_steps_use_all_anchors(spark, sf, name):
    """Runs of over 500 and under 5,000 anchors: the curve spans all of them."""
    want = {r["run"]: r for r in files._anchors(spark, sf).groupBy("run").agg(F.count("*").alias("n"), F.min("pred").alias("lo"), F.max("pred").alias("hi")).collect()}
    assert any(500 < r["n"] <= 5000 for r in want.values())
    for r in files.QUERIES[name](spark, sf).groupBy("run").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        assert abs(r["lo"] - want[r["run"]]["lo"]) < 1e-3 and abs(r["hi"] - want[r["run"]]["hi"]) < 1e-3


def test_bootstrap_has_all_replicates(spark, sf, monkeypatch):
    from massloom.plans import spectra

    seen = []

    def bootstrap(matches, replicates=500, share=0.5):
        seen.append(replicates)
        return matches.select("psm", F.lit(0.0).alias("bootstrap_similarity"))

    assert spectra.similarity.bootstrap.__defaults__ == bootstrap.__defaults__
    monkeypatch.setattr(spectra.similarity, "bootstrap", bootstrap)
    spectra.QUERIES["bootstrap_similarity"](spark, sf)
    assert seen == [500]
