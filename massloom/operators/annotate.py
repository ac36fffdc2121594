"""Annotation of m/z values by theoretical ions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.match import bounds, range_join


def annotate(rows: DataFrame, theory: DataFrame, priority: list[str], *, tolerance: float, unit: str, by: tuple[str, ...], keys: list[str], width: float = 1.0) -> DataFrame:
    """Adds ``names``: of the theoretical ions (keys, ion, name, mz) in the window of each row's mz, those of the best ion type that has a hit, joined by ``;``; ``unknown`` without one."""
    low, high = bounds(F.col("mz"), tolerance, unit)
    found = range_join(rows, theory, keys, low, high, "mz", width)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("peak_ion")), F.lit(0))
    found = found.withColumn("__rank", F.when(rank == 0, len(priority) + 1).otherwise(rank))
    best = found.withColumn("__best", F.min(F.when(F.col("peak_name").isNotNull(), F.col("__rank"))).over(Window.partitionBy(*by)))
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("__rank") == F.col("__best"), F.col("peak_name")))), ";")
    return best.groupBy(*by).agg(names.alias("names")).withColumn("names", F.when(F.col("names") == "", "unknown").otherwise(F.col("names")))
