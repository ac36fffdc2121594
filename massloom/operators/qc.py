"""Quality summaries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.ranks import group_ranks


def score_histogram(psms: DataFrame, value: Column, n: int = 100, by: tuple[str, ...] = ("label",), integers: bool = False) -> DataFrame:
    """Counts per label and bin of n equal bins (or one per integer); values that are not finite are counted in bin -1."""
    rows = psms.select(*by, value.alias("v")).withColumn("ok", F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    if integers:
        place = F.floor("v").cast("int")
        return rows.groupBy(*by, F.when(F.col("ok"), place).otherwise(-1).alias("bin")).count()
    ends = rows.filter("ok").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.least(F.lit(n - 1), F.floor(F.try_divide((F.col("v") - F.col("low")) * n, F.col("high") - F.col("low")))).cast("int")
    placed = rows.join(F.broadcast(ends), F.lit(True), "cross")
    return placed.groupBy(*by, F.when(F.col("ok"), F.coalesce(at, F.lit(0))).otherwise(-1).alias("bin")).count()


def log_value(value: Column) -> Column:
    return F.log10(value + 0.01)


def run_percentiles(psms: DataFrame, value: str) -> DataFrame:
    """Per run n and five values by index: floor(kn/20) for 5 and 95 %, floor(kn/4) for quartiles; runs by median.

    The indexes are picked by ranks that are made over ranges, so no run's values meet in one task.
    """
    rows = group_ranks(psms.filter(F.col(value).isNotNull()).select("run", value), ("run",), (value,), "r", "n").withColumn("r", F.col("r") - 1)
    picks = {"p5": F.floor(F.col("n") / 20), "p25": F.floor(F.col("n") / 4), "p50": F.floor(F.col("n") / 2), "p75": F.floor(3 * F.col("n") / 4), "p95": F.floor(19 * F.col("n") / 20)}
    found = rows.groupBy("run").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("r") == at, F.col(value))).alias(k) for k, at in picks.items()))
    return found.withColumn("place", F.row_number().over(Window.orderBy("p50", "run")).cast("long"))


def delta_trend(anchors: DataFrame, delta: str, size: int = 20) -> DataFrame:
    """Anchors by retention time in n / size equal-count bins: median, 5th and 95th percentile and mean time, then averaged over +-ceil(bins / 60) bins."""
    rows = group_ranks(anchors.select("run", "exp_rt", "psm_id", delta), ("run",), ("exp_rt", "psm_id"), "r", "n").withColumn("r", F.col("r") - 1)
    bins = F.greatest(F.lit(1), F.floor(F.col("n") / size))
    rows = rows.withColumn("bins", bins).withColumn("bin", F.floor(F.col("r") * F.col("bins") / F.col("n")).cast("int"))
    stats = rows.groupBy("run", "bins", "bin").agg(F.percentile(delta, F.lit(0.5)).alias("median"), F.percentile(delta, F.lit(0.05)).alias("p5"), F.percentile(delta, F.lit(0.95)).alias("p95"), F.avg("exp_rt").alias("rt"))
    half = F.ceil(F.col("bins") / 60).cast("int")
    # The frame's width depends on the run: each bin goes to the bins that it counts for.
    spread = stats.withColumn("to", F.explode(F.sequence(F.col("bin") - half, F.col("bin") + half))).filter((F.col("to") >= 0) & (F.col("to") < F.col("bins")))
    return spread.groupBy("run", F.col("to").alias("bin")).agg(*(F.avg(c).alias(c) for c in ("median", "p5", "p95")), F.max(F.when(F.col("bin") == F.col("to"), F.col("rt"))).alias("rt"))


def moments(psms: DataFrame, value: str, by: tuple[str, ...] = ("run",), width: float = 1e-4) -> DataFrame:
    """count, mean, sd and the median of values put in bins of ``width``."""
    binned = F.floor(F.col(value) / width) * width
    return psms.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(binned, F.lit(0.5)).alias("median"))


def descriptive(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ("run",)) -> DataFrame:
    diff = F.col(x) - F.col(y)
    return rows.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.covar_samp(x, y).alias("covariance"), F.percentile(x, F.lit(0.5)).alias("median"),
        F.avg(diff * diff).alias("mse"), F.sum(diff * diff).alias("rss"),
    )


def moving_average(rows: DataFrame, value: str, half: int, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("moving", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)))
