"""Every registered query runs; those with an oracle equal DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from massloom.operators.ranks import first_rows, group_ranks
from massloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples: numbers to 9 digits, nulls alike."""
    value = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)
    return sorted(map(repr, (tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    """Queries without SQL give finite values; test_curves.py holds them against plain versions."""
    rows = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(rows)
    numbers = rows.select_dtypes("number")
    assert not numbers.isin([float("inf"), float("-inf")]).any().any()


def test_curves_are_monotone_and_close(spark, sf):
    rows = catalog.QUERIES["curve_eval"](spark, sf).toPandas().sort_values(["run", "x"])
    assert (rows.groupby("run").y.diff().dropna() >= -1e-6).all()


def test_scores_are_bounded(spark, sf):
    for name in ("unweighted_spectral_entropy", "bootstrap_similarity", "cosine_similarity"):
        found = catalog.QUERIES[name](spark, sf).toPandas()[name]
        assert found.between(-1e-6, 1 + 1e-6).all()


def test_ranks_of_groups(spark):
    rows = [(None if k % 7 == 0 else f"g{k % 3}", k * 37 % 101, k) for k in range(400)]
    got = group_ranks(spark.createDataFrame(rows, "g string, v long, k long"), ("g",), ("v", "k")).collect()
    groups = {}
    for g, v, k in rows:
        groups.setdefault(g, []).append((v, k))
    want = {(g, v, k, i, len(m)) for g, m in groups.items() for i, (v, k) in enumerate(sorted(m), 1)}
    assert {tuple(r) for r in got} == want


def test_first_rows_of_large_groups(spark):
    rows = [(f"g{k % 2}", k * 37 % 5003) for k in range(5003)]
    got = first_rows(spark.createDataFrame(rows, "g string, v long"), 1200, ("g",), ("v",), parts=3).collect()
    want = {(g, v) for g in ("g0", "g1") for v in sorted(v for h, v in rows if h == g)[:1200]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
