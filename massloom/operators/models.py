"""Choice of prediction models and collision energies from scores of many models at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.ranks import first_rows, group_ranks
from massloom.sources.store import written

FLT_MAX = 3.4028234663852886e38
#: Padding rows that are made at once.
BLOCK = 65_536


def top_psms(psms: DataFrame, total: int, *, label: int | None = None, charge: int | None = None) -> DataFrame:
    """ceil(total / runs) PSMs per run: the cutoff is that e-value in order, then the first rows in file order at or below it."""
    rows = psms if label is None else psms.filter(F.col("label") == label)
    rows = rows if charge is None else rows.filter(F.col("charge") == charge)
    runs = psms.agg(F.count_distinct("run")).first()[0]
    n = -(-total // max(1, runs))
    cut = first_rows(rows.select("run", "evalue", "psm_id"), n, ("run",), ("evalue", "psm_id")).groupBy(F.col("run").alias("__run")).agg(F.max("evalue").alias("__cut"))
    near = rows.join(cut, F.col("run").eqNullSafe(F.col("__run"))).filter(F.col("evalue") <= F.col("__cut")).drop("__run", "__cut")
    return first_rows(near, n, ("run",), ("psm_id",))


def median_scores(scores: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    return scores.groupBy(*by).agg(F.percentile("score", F.lit(0.5)).alias("median"))


def best_energy(scores: DataFrame) -> DataFrame:
    """model, energy: the energy with the highest median score, which must be above 0; of equals the lowest."""
    medians = median_scores(scores, ("model", "energy")).filter("median > 0")
    return medians.groupBy("model").agg(F.max_by("energy", F.struct("median", -F.col("energy"))).alias("energy"), F.max("median").alias("median"))


def padded(scores: DataFrame, bigger_is_better: bool = True) -> DataFrame:
    """model, i, score: each model's scores ascending, filled up to the longest one with the worst value first or last."""
    ranked = written(group_ranks(scores.select("model", "score"), ("model",), ("score",), "i", "n"), "ranked")
    sizes = written(ranked.groupBy("model").agg(F.max("n").alias("n")), "sizes")  # one row per model
    longest = sizes.agg(F.max("n").alias("longest"))
    short = sizes.join(F.broadcast(longest), F.lit(True), "cross")  # one row on the right
    gap = F.col("longest") - F.col("n")
    first = F.lit(0) if bigger_is_better else F.col("n")
    blocks = short.filter(gap > 0).select("model", first.alias("first"), gap.alias("gap"), F.explode(F.sequence(F.lit(0), F.floor((gap - 1) / BLOCK))).alias("block"))
    places = F.sequence(F.col("block") * BLOCK + 1, F.least(F.col("gap"), (F.col("block") + 1) * BLOCK))
    fill = blocks.select("model", "first", F.explode(places).alias("k")).select("model", (F.col("first") + F.col("k")).alias("i"), F.lit(-FLT_MAX if bigger_is_better else FLT_MAX).alias("score"))
    moved = ranked.join(short.select("model", gap.alias("gap")), "model")
    place = F.col("i") + (F.col("gap") if bigger_is_better else F.lit(0))
    return moved.select("model", place.alias("i"), "score").unionByName(fill.select("model", "i", "score"))


def score_matrix(scores: DataFrame, models: list[str], bigger_is_better: bool = True) -> DataFrame:
    """Row i holds the i-th score of each model."""
    return padded(scores, bigger_is_better).groupBy("i").pivot("model", models).agg(F.first("score"))


def consensus(scores: DataFrame, ranks: int, *, bigger_is_better: bool = True, top: bool = True) -> DataFrame:
    """model, votes: at each of the first (or last) ranks the best model gets a vote; of equals the first name. Scores that must be bigger count only above 0."""
    if bigger_is_better == top:
        # Padding lies behind all scores of a model and never wins: Spark cuts each model to its ranks before the shuffle.
        order = F.desc("score") if top else F.asc("score")
        rank = F.row_number().over(Window.partitionBy("model").orderBy(order))
        rows = scores.select("model", "score", rank.alias("rank")).filter(F.col("rank") <= ranks)
    else:
        rows = padded(scores, bigger_is_better)
        n = F.max("i").over(Window.partitionBy("model"))
        rows = rows.withColumn("rank", (n - F.col("i") + 1) if top else F.col("i")).filter(F.col("rank") <= ranks)
    if bigger_is_better:
        rows = rows.filter("score > 0")
    order = F.desc("score") if bigger_is_better else F.asc("score")
    best = rows.withColumn("__r", F.row_number().over(Window.partitionBy("rank").orderBy(order, "model"))).filter("__r = 1")
    return best.groupBy("model").agg(F.count("*").alias("votes"))


def rmse(residuals: DataFrame) -> DataFrame:
    return residuals.groupBy("model").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
