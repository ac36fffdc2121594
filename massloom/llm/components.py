"""Connected components of a link table, by alternating star contractions as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.common import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b (comparable, not null). One row per node that has a link: ``node`` and ``root``, the smallest node of its component.

    Each round turns every node's neighbours to the smallest one, first the larger neighbours, then the smaller ones,
    until nothing changes; the rounds grow with the logarithm of the longest path. Each round is a written table.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        links = written(small.filter("a <> b").distinct(), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
