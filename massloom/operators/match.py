"""Joins of predicted fragments with observed peaks inside a mass tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of an m/z bucket; it must be at least the tolerance at the largest m/z.
BUCKET = 1.0


def bounds(mz: Column, tolerance: float | Column, unit: str | Column = "ppm") -> tuple[Column, Column]:
    """Closed window around an m/z. ``unit`` is ppm or da, as a word or a column."""
    t = F.lit(tolerance) if isinstance(tolerance, float | int) else tolerance
    ppm = (mz * (1 - t * F.lit(1e-6)), mz * (1 + t * F.lit(1e-6)))
    da = (mz - t, mz + t)
    if isinstance(unit, str):
        return ppm if unit == "ppm" else da
    return F.when(unit == "ppm", ppm[0]).otherwise(da[0]), F.when(unit == "ppm", ppm[1]).otherwise(da[1])


def range_join(probe: DataFrame, peaks: DataFrame, keys: list[str], low: Column, high: Column, at: str, width: float = BUCKET) -> DataFrame:
    """Left join of probe rows with the peaks of the same keys whose ``at`` lies in [low, high].

    An equality join on m/z buckets: each probe row visits the buckets that its window touches, mostly one. Catalyst
    has no range join, and without the bucket every scan's rows would meet pairwise. The bucket is part of the key, so
    a run or scan with many rows is spread over tasks.
    """
    left = probe.withColumns({"__low": low, "__high": high})
    left = left.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))))
    right = peaks.withColumn("__bucket", F.floor(F.col(at) / width))
    right = right.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__bucket").alias("__at_bucket"), *(F.col(c).alias(f"peak_{c}") for c in peaks.columns if c not in keys))
    same = F.col("__bucket") == F.col("__at_bucket")
    for k in keys:
        same &= F.col(k) == F.col(f"__{k}")
    inside = F.col(f"peak_{at}").between(F.col("__low"), F.col("__high"))
    return left.join(right, same & inside, "left").drop("__low", "__high", "__bucket", "__at_bucket", *(f"__{k}" for k in keys))


def peak_match(fragments: DataFrame, peaks: DataFrame, *, tolerance: float = 20.0, unit: str = "ppm", width: float = BUCKET, by: tuple[str, ...] = ("psm", "pos")) -> DataFrame:
    """Each fragment with ``matched``: the highest peak of its scan inside the window, 0 without one. A peak may serve many fragments."""
    low, high = bounds(F.col("mz"), tolerance, unit)
    found = range_join(fragments, peaks.select("scan", "mz", "intensity"), ["scan"], low, high, "mz", width)
    rest = [F.first(c).alias(c) for c in fragments.columns if c not in by]
    return found.groupBy(*by).agg(*rest, F.coalesce(F.max("peak_intensity"), F.lit(0.0)).alias("matched"))


def peak_match_arrays(matches: DataFrame, *, tolerance: float = 20.0, unit: str = "ppm") -> DataFrame:
    """The same for one row per match with arrays ``fragments`` and ``peaks``: no shuffle beyond the join that made the row."""

    def best(f: Column) -> Column:
        low, high = bounds(f["mz"], tolerance, unit)
        inside = F.filter("peaks", lambda p: p["mz"].between(low, high))
        return F.coalesce(F.array_max(F.transform(inside, lambda p: p["intensity"])), F.lit(0.0))

    return matches.withColumn("matched", F.transform("fragments", best))


def tolerance_mode(forced_da: Column, ion_type: Column, primary: list[str] | None, primary_unit: str, aux_unit: str, default: str = "ppm") -> Column:
    """Unit of a fragment's window: the match's own flag first, then whether its ion type is a primary one."""
    unit = F.lit(default) if primary is None else F.when(ion_type.isin(primary), primary_unit).otherwise(aux_unit)
    return F.when(forced_da, "da").otherwise(unit)
