"""Incremental run quality: moments of scored PSMs per run as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.sources.store import shared_dir


def stream_moments(scored: DataFrame, value: str, by: str = "run", width: float = 1.0) -> DataFrame:
    """n, mean and m2 (sum of squares around the mean) of each run and bin of a histogram of ``width``: state is bounded by the runs and their bins.

    Spark keeps and merges the three as central moments, so large values with a small spread lose nothing. Works on a
    stream (update or complete mode) and on a batch alike.
    """
    rows = scored.select(F.col(by).alias("run"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    return rows.groupBy("run", F.floor(F.col("v") / width).alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("m2"))


def summary(state: DataFrame, width: float = 1.0) -> DataFrame:
    """n, mean, sd and binned median of each run from the state of ``stream_moments``.

    Bins merge as central moments do: their own squares, and those of their means around the run's mean, which is
    itself summed as differences from the run's first mean.
    """
    w = Window.partitionBy("run")
    rows = state.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w), "base": F.min("mean").over(w)})
    rows = rows.withColumn("whole", F.col("base") + F.sum(F.col("n") * (F.col("mean") - F.col("base"))).over(w) / F.col("total"))
    away = F.col("mean") - F.col("whole")
    m2 = F.sum(F.col("m2") + F.col("n") * away * away)
    median = F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("bin"))) * width
    sd = F.when(F.sum("n") > 1, F.sqrt(m2 / (F.sum("n") - 1)))
    return rows.groupBy("run").agg(F.sum("n").alias("n"), F.first("whole").alias("mean"), sd.alias("sd"), median.alias("median"))


def run_available(spark: SparkSession, source: str, schema: T.StructType, value: str, by: str = "run", width: float = 1.0) -> DataFrame:
    """Process the Parquet files that are there as a stream with a checkpoint, and return the final summary."""
    target, marks = shared_dir(spark, "run-qc"), shared_dir(spark, "run-qc-marks")
    stream = stream_moments(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source), value, by, width)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.parquet(*[f"{target}/batch=*"]).groupBy("run", "bin").agg(*(F.max_by(c, "batch").alias(c) for c in ("n", "mean", "m2")))
    return summary(state, width)
