"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.sources.store import written

#: Up to so many rows a group Spark cuts groups before it shuffles them (the default of its window group limit).
LIMITED = 1000


def group_ranks(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], rank: str = "rank", size: str = "size") -> DataFrame:
    """Adds ``rank`` (from 1, in ascending ``order``) and ``size`` (rows) of each row's group.

    A plain window would sort a whole group in one task. Here rows are ranged by group and order, numbered within the
    part of a group that a range holds, and moved by the sizes of the parts before; those are as many as ranges and
    groups together. The ranges are written first so that their bounds hold.
    """
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    part = Window.partitionBy("__part", *by)
    group = Window.partitionBy(*by)
    sizes = ranged.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("__part").alias("__of"), *(F.col(b).alias(f"__of_{b}") for b in by), F.coalesce(upto, F.lit(0)).alias("__before"), F.sum("__n").over(group).alias(size))
    placed = ranged.withColumn("__r", F.row_number().over(part.orderBy(*order)))
    same = F.col("__part") == F.col("__of")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__of_{b}"))
    return placed.join(sizes, same).select(*rows.columns, (F.col("__before") + F.col("__r")).alias(rank), size)


def first_rows(rows: DataFrame, n: int, by: tuple[str, ...], order: tuple[str, ...], parts: int = 64) -> DataFrame:
    """The first n rows of each group in ``order``.

    Spark cuts each task's rows before the shuffle if n is small. Beyond that, a group is first cut in ``parts`` parts of
    its own, so that at most parts * n of its rows meet in one task.
    """
    if n > LIMITED:
        part = Window.partitionBy(*by, "__part").orderBy(*order)
        spread = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
        rows = spread.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= n).drop("__r", "__part")
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")
