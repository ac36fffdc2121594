"""Views that give the driver's tables the shape of search results, spectra and predicted fragments.

Each view exists as a DataFrame and as DuckDB SQL (a common table expression of the same name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def psm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search result per distinct line item key."""
    c = F.col
    key = c("l_orderkey") * 1000000000 + c("l_linenumber") * 100000000 + c("l_partkey") * 1000 + c("l_suppkey") % 1000
    rows = read(spark, sf_dir, "lineitem").groupBy(key.alias("psm_id")).agg(
        F.concat(F.lit("run_"), F.min(c("l_suppkey") % 4).cast("string")).alias("run"),
        F.min("l_orderkey").alias("scan_num"),
        F.min(1 + c("l_partkey") % 4).cast("long").alias("charge"),
        F.concat(F.lit("PEP"), F.min(c("l_partkey") % 500).cast("string")).alias("peptide"),
        F.min(F.when(c("l_returnflag") == "R", 0).otherwise(1)).cast("long").alias("label"),
        F.pow(F.lit(10.0), -F.min("l_quantity") / 5).alias("evalue"),
        (F.min("l_quantity") + F.min("l_discount") * 10).alias("exp_rt"),
        (F.min("l_extendedprice") / 1000).alias("pred_rt"),
        F.min("l_quantity").alias("hyperscore"),
    )
    return rows


PSM = """psm as (
select l_orderkey*1000000000 + l_linenumber*100000000 + l_partkey*1000 + l_suppkey % 1000 as psm_id,
  concat('run_', cast(min(l_suppkey % 4) as varchar)) as run, min(l_orderkey) as scan_num,
  cast(min(1 + l_partkey % 4) as bigint) as charge, concat('PEP', cast(min(l_partkey % 500) as varchar)) as peptide,
  cast(min(case when l_returnflag = 'R' then 0 else 1 end) as bigint) as label, power(10.0::double, -min(l_quantity)/5) as evalue,
  min(l_quantity) + min(l_discount)*10 as exp_rt, min(l_extendedprice)/1000 as pred_rt, min(l_quantity) as hyperscore
from lineitem group by 1)"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observed peak per component of each vector."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scan"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select("scan", F.col("pos").cast("long").alias("pos"), (100 + 10 * F.col("pos")).cast("double").alias("mz"), (F.abs(F.col("v").cast("double")) * 1000).alias("intensity"))


PEAKS = """peaks as (
select scan, cast(pos as bigint) as pos, cast(100 + 10*pos as double) as mz, abs(cast(v as double))*1000 as intensity
from (select vec_id as scan, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from embeddings))"""


def frags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted fragments: the vector before, its m/z shifted by -30 to 30 ppm."""
    p = peaks(spark, sf_dir)
    return p.select(
        (F.col("scan") + 1).alias("psm"),
        (F.col("scan") + 1).alias("scan"),
        "pos",
        (F.col("mz") * (1 + (F.col("pos") % 5 - 2) * F.lit(0.000015))).alias("mz"),
        "intensity",
        F.when(F.col("pos") % 2 == 0, "b").otherwise("y").alias("ion_type"),
    )


FRAGS = (
    PEAKS
    + """, frags as (
select scan + 1 as psm, scan + 1 as scan, pos, mz*(1 + (pos % 5 - 2)*0.000015::double) as mz, intensity,
  case when pos % 2 = 0 then 'b' else 'y' end as ion_type from peaks)"""
)


def with_views(body: str, *views: str) -> str:
    return "with " + ", ".join(views) + (body if body.startswith(",") else f" {body}")
