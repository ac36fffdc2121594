"""Spectral similarity as grouped aggregates over the match table.

A match table has one row per kept fragment: ``psm``, ``pos``, ``p`` (predicted intensity), ``m`` (matched intensity, 0
without a peak), ``w`` (weight) and ``ion_type``. Every score is one row per match (and per further ``by`` column).
Scores with fewer than ``least`` fragments, or without a matched peak, have the fixed values below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST = 2
NO_MATCH_DISTANCE = 1 - 2**0.5


def _sum(x: Column) -> Column:
    return F.sum(x)


def normalized(matches: DataFrame, by: tuple[str, ...] = ("psm",), p: str = "p", m: str = "m") -> DataFrame:
    """Adds p1, m1 (sum 1) and pu, mu (length 1); a zero vector stays zero, a vector of one value has sum-1 value 1."""
    w = Window.partitionBy(*by)

    def scaled(c: str, total: Column) -> Column:
        return F.when(total > 0, F.col(c) / total).otherwise(0.0)

    def one(c: str) -> Column:
        return F.when(F.count("*").over(w) == 1, 1.0).otherwise(scaled(c, F.sum(c).over(w)))

    unit = lambda c: scaled(c, F.sqrt(F.sum(F.col(c) * F.col(c)).over(w)))
    return matches.withColumns({"p1": one(p), "m1": one(m), "pu": unit(p), "mu": unit(m)})


def weighted_units(matches: DataFrame, by: tuple[str, ...] = ("psm",)) -> DataFrame:
    """Adds pw, mw: the weighted unit vectors, scaled to length 1 again."""
    w = Window.partitionBy(*by)
    rows = matches.withColumns({"__p": F.col("w") * F.col("pu"), "__m": F.col("w") * F.col("mu")})
    unit = lambda c: F.when(F.sum(F.col(c) * F.col(c)).over(w) > 0, F.col(c) / F.sqrt(F.sum(F.col(c) * F.col(c)).over(w))).otherwise(0.0)
    return rows.withColumns({"pw": unit("__p"), "mw": unit("__m")}).drop("__p", "__m")


def ranked(matches: DataFrame, by: tuple[str, ...] = ("psm",)) -> DataFrame:
    """Adds pr, mr: ranks with ties averaged."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    return matches.withColumns({"pr": rank("p"), "mr": rank("m")})


def entropy(v: Column) -> Column:
    """Spectral entropy of a vector whose values are the rows."""
    return -F.sum(F.when(v != 0, v * F.ln(v)).otherwise(0.0))


def _entropy_score(p1: str, m1: str) -> Column:
    a, b = F.col(p1), F.col(m1)
    score = 1 - (2 * entropy((a + b) / 2) - entropy(b) - entropy(a)) / F.ln(F.lit(4.0))
    enough = (F.count("*") >= LEAST) & (F.sum((b != 0).cast("int")) >= LEAST)
    return F.when(enough, score).otherwise(0.0)


def _guarded(score: Column, few: float, none: float, matched: Column) -> Column:
    return F.when(F.count("*") < LEAST, few).when(matched == 0, none).otherwise(score)


def _cosine(w: Column) -> Column:
    p, m = F.col("p"), F.col("m")
    den = F.sqrt(F.sum(p * p * w) * F.sum(m * m * w))
    return F.when((F.count("*") < LEAST) | (den == 0), 0.0).otherwise(F.sum(p * m * w) / den)


def _angle(cosine: Column) -> Column:
    return F.when(F.count("*") < LEAST, 0.0).otherwise(1 - 2 * F.acos(F.least(cosine, F.lit(1.0))) / F.lit(3.141592653589793))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; null, not an error, where one side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _correlation(a: str, b: str, few: float) -> Column:
    return _guarded(correlation(F.col(a), F.col(b)), few, -1.0, F.sum("m"))




def scores() -> dict[str, Column]:
    """Aggregate of every score, over a table with all columns of ``prepared``."""
    p, m, w, pu, mu, pw, mw = map(F.col, ("p", "m", "w", "pu", "mu", "pw", "mw"))
    one = F.lit(1.0)
    unweighted = _entropy_score("p1", "m1")
    heuristic = _entropy_score("ph", "mh")
    return {
        "cosine_similarity": _cosine(one),
        "weighted_cosine": _cosine(w),
        "spectral_contrast_angle": _angle(_cosine(one)),
        "weighted_contrast_angle": _angle(_cosine(w)),
        "euclidean_distance": _guarded(1 - F.sqrt(F.sum((pu - mu) * (pu - mu))), 0.0, NO_MATCH_DISTANCE, F.sum("mu")),
        "weighted_euclidean": _guarded(1 - F.sqrt(F.sum((pw - mw) * (pw - mw))), 0.0, NO_MATCH_DISTANCE, F.sum("mu")),
        "bray_curtis": _guarded(1 - F.sum(F.abs(mu - pu)) / F.sum(mu + pu), 0.0, 0.0, F.sum("mu")),
        "weighted_bray_curtis": _guarded(1 - F.sum(w * F.abs(mu - pu)) / F.sum(w * (mu + pu)), 0.0, 0.0, F.sum("mu")),
        "pearson_corr": _correlation("p", "m", -1.0),
        "spearman_corr": _correlation("pr", "mr", -1.0),
        "weighted_pearson": _guarded(correlation(w * p, w * m), 0.0, -1.0, F.sum("m")),
        "dot_product": _guarded(F.sum(pu * mu), 0.0, 0.0, F.sum("m")),
        "weighted_dot_product": _guarded(F.sum(w * p * w * m) / (F.max(w * p) * F.max(w * m)), 0.0, 0.0, F.sum("m")),
        "spectral_entropy": entropy(F.col("p1")),
        "unweighted_spectral_entropy": unweighted,
        "weighted_spectral_entropy": unweighted * F.sqrt(entropy(F.col("p1"))),
        "heuristic_spectral_entropy": heuristic,
    }


def powered(matches: DataFrame, by: tuple[str, ...] = ("psm",)) -> DataFrame:
    """Adds ph, mh: both vectors raised to entropy / 2.75 where the predicted entropy is below 1.75, then to sum 1."""
    w = Window.partitionBy(*by)
    f = F.col("p1")
    e = -F.sum(F.when(f != 0, f * F.ln(f)).otherwise(0.0)).over(w)
    rows = matches.withColumn("__e", e)
    low = F.col("__e") < 1.75
    rows = rows.withColumns({"__p": F.when(low, F.pow("p", F.col("__e") / 2.75)).otherwise(F.col("p1")), "__m": F.when(low, F.pow("m", F.col("__e") / 2.75)).otherwise(F.col("m1"))})
    scaled = lambda c: F.when(F.count("*").over(w) == 1, 1.0).when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)).otherwise(0.0)
    return rows.withColumns({"ph": scaled("__p"), "mh": scaled("__m")}).drop("__e", "__p", "__m")


#: Columns that a score needs beyond the normalised vectors.
NEEDS = {"weighted_euclidean": weighted_units, "spearman_corr": ranked, "heuristic_spectral_entropy": powered}


def similarity(matches: DataFrame, names: list[str], by: tuple[str, ...] = ("psm",)) -> DataFrame:
    """The named scores, one row per ``by``: one shuffle by psm serves the windows and the aggregate."""
    rows = normalized(matches, by)
    for name in names:
        if name in NEEDS:
            rows = NEEDS[name](rows, by)
    known = scores()
    return rows.groupBy(*by).agg(*(known[n].alias(n) for n in names))


def fragment_groups(mode: str, ions: list[str], aux: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """The ion types of each group of a mode, by the group's name (its types in order, joined by _).

    ions: the types of the method's hierarchy; aux: those of the auxiliary model. Modes: all (one group), aux (primary
    and auxiliary types), yb (y and b; the rest), yb_unknown (y and b; the rest; unknown), each (one group a type) and
    electron (c, y, z and zdot; unknown). Types without a group take no part, and a group without types has no name and goes.
    """
    rest = [i for i in ions if i not in ("y", "b")]
    sets = {
        "all": [ions],
        "aux": [[i for i in ions if i not in aux], list(aux)],
        "yb": [["y", "b"], rest],
        "yb_unknown": [["y", "b"], [i for i in rest if i != "unknown"], ["unknown"]],
        "each": [[i] for i in ions],
        "electron": [["zdot", "z", "c", "y"], ["unknown"]],
    }
    if mode not in sets:
        raise ValueError(f"{mode}: not one of {', '.join(sets)}")
    return {"_".join(sorted(set(g))): sorted(set(g)) for g in sets[mode] if g}


def group_table(spark: SparkSession, modes: list[str], ions: list[str], aux: tuple[str, ...] = ()) -> DataFrame:
    """mode, grp and ion_type; a parameter table of a few rows a mode."""
    rows = [(m, g, i) for m in modes for g, members in fragment_groups(m, ions, aux).items() for i in members]
    return spark.createDataFrame(rows, "mode string, grp string, ion_type string")


def grouped_similarity(matches: DataFrame, names: list[str], groups: DataFrame) -> DataFrame:
    """psm, mode, grp and the named scores over the fragments of each group: rows fan out to their groups once, before the one shuffle."""
    return similarity(matches.join(F.broadcast(groups), "ion_type"), names, ("psm", "mode", "grp"))


def group_columns(matches: DataFrame, names: list[str], mode: str, ions: list[str], aux: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """psm and a column ``name^group`` for each score and group of a mode (``name`` alone if there is one group); 0 for a group without fragments."""
    found = grouped_similarity(matches, names, group_table(matches.sparkSession, [mode], ions, aux))
    groups = list(fragment_groups(mode, ions, aux))
    label = lambda n, g: n if len(groups) == 1 else f"{n}^{g}"
    one = lambda n, g: F.coalesce(F.max(F.when(F.col("grp") == g, F.col(n))), F.lit(0.0))
    made = {label(n, g): one(n, g) if digits is None else F.round(one(n, g), digits) for n in names for g in groups}
    return found.groupBy("psm").agg(*(c.alias(n) for n, c in made.items()))


def bin_weights(matches: DataFrame, table: DataFrame, width: float) -> DataFrame:
    """Adds w: the weight of the fragment's m/z bin, 0 past the end of the table (bin, weight)."""
    rows = matches.withColumn("bin", F.floor(F.col("mz") / width).cast("long"))
    return rows.join(table.select("bin", F.col("weight").alias("w")), "bin", "left").withColumn("w", F.coalesce("w", F.lit(0.0))).drop("bin")


#: ln(n!) of small n; beyond, Stirling's series.
_SMALL = [math.lgamma(n + 1) for n in range(128)]


def log_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    stirling = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + series
    return F.when(n < len(_SMALL), F.element_at(F.array(*map(F.lit, _SMALL)), F.greatest(n, F.lit(0)).cast("int") + 1)).otherwise(stirling)


def hypergeometric(counts: DataFrame) -> DataFrame:
    """-log10 P(X >= k): counts has psm, population, matched (of the population), draws and k (both capped here). The tail is a sum over k..min."""
    whole = {c: F.col(c).cast("int") for c in ("population", "matched", "draws", "k")}
    rows = counts.withColumns(whole).withColumns({"k": F.least("k", "matched"), "draws": F.least("draws", "population")})

    def choose(n: Column, r: Column) -> Column:
        return log_factorial(n) - log_factorial(r) - log_factorial(n - r)

    rest = F.col("population") - F.col("matched")
    low = F.greatest(F.col("k"), F.col("draws") - rest)
    high = F.least("matched", "draws")
    rows = rows.withColumns({"low": low, "high": high, "all": choose(F.col("population"), F.col("draws"))})
    term = lambda x: F.exp(choose(F.col("matched"), x) + choose(F.col("population") - F.col("matched"), F.col("draws") - x) - F.col("all"))
    tail = F.when(F.col("low") > F.col("high"), F.lit(0.0)).otherwise(F.aggregate(F.sequence("low", F.greatest("low", "high")), F.lit(0.0), lambda a, x: a + term(x)))
    score = F.when((F.col("draws") <= 1) | (F.col("population") == 0), 0.0).otherwise(F.lit(0.0) - F.log10(F.least(tail, F.lit(1.0))))
    return rows.select("psm", score.alias("hypergeometric_probability"))


def theoretical_ions(theory: DataFrame, predicted: DataFrame, scans: DataFrame) -> DataFrame:
    """The theoretical ions (psm, scan, ion_type, mz and more) of the ion types that are predicted for their match, inside the scan's window (scan, ms2_lo, ms2_hi); of equal m/z, one."""
    kinds = predicted.select("psm", "ion_type").distinct()
    rows = theory.join(kinds, ["psm", "ion_type"], "left_semi").join(scans.select("scan", "ms2_lo", "ms2_hi"), "scan")
    return rows.filter(F.col("mz").between(F.col("ms2_lo"), F.col("ms2_hi"))).drop("ms2_lo", "ms2_hi").dropDuplicates(["psm", "mz"])


def intersection(theoretical: DataFrame, matches: DataFrame, top: int = 20) -> DataFrame:
    """How many of the top non-zero theoretical intensities (psm, intensity) occur among the matched ones; the lowest value of all is never looked at."""
    order = Window.partitionBy("psm").orderBy(F.desc("intensity"), "pos")
    n = F.count("*").over(Window.partitionBy("psm"))
    best = theoretical.withColumns({"r": F.row_number().over(order), "n": n}).filter((F.col("r") <= top) & (F.col("r") < F.col("n")) & (F.col("intensity") > 0))
    hit = best.join(matches.select("psm", F.col("m").alias("intensity")).distinct(), ["psm", "intensity"], "left_semi").groupBy("psm").agg(F.count("*").alias("hits"))
    return theoretical.select("psm").distinct().join(hit, "psm", "left").select("psm", F.coalesce("hits", F.lit(0)).alias("intersection"))


def top6(matches: DataFrame, peaks: DataFrame) -> DataFrame:
    """Sum of ln(m + 1) over the six highest predicted, over that of ln(i + 1) of the scan's peaks above its mean; 0 where none is."""
    order = Window.partitionBy("psm").orderBy(F.desc("p"), "pos")
    best = matches.withColumns({"r": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("psm"))}).filter("r <= 6").groupBy("psm").agg(F.first("scan").alias("scan"), F.max("n").alias("n"), F.sum(F.ln(F.col("m") + 1)).alias("num"))
    mean = F.avg("intensity").over(Window.partitionBy("scan"))
    den = peaks.withColumn("__mean", mean).groupBy("scan").agg(F.sum(F.when(F.col("intensity") > F.col("__mean"), F.ln(F.col("intensity") + 1)).otherwise(0.0)).alias("den"))
    score = F.when((F.col("n") >= LEAST) & (F.col("den") > 0), F.col("num") / F.col("den")).otherwise(0.0)
    return best.join(den, "scan", "left").select("psm", score.alias("top6_matched_intensity"))


def longest_run(matches: DataFrame) -> DataFrame:
    """Longest run of neighbouring matched fragments."""
    rows = matches.withColumns({"r": F.row_number().over(Window.partitionBy("psm").orderBy("pos")), "hit": F.col("m") > 0})
    island = F.col("r") - F.row_number().over(Window.partitionBy("psm", "hit").orderBy("pos"))
    runs = rows.withColumn("island", island).groupBy("psm", "hit", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("psm").agg(F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("longest_match_run"))


def _array_entropy(v: Column) -> Column:
    return -F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x != 0, x * F.ln(x)).otherwise(0.0))


def _share(v: Column) -> Column:
    """The values of an array scaled to sum 1; a single value is 1."""
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(v) == 1, F.array(F.lit(1.0))).otherwise(F.transform(v, lambda x: F.when(total > 0, x / total).otherwise(0.0)))


def array_entropy_score(p: Column, m: Column) -> Column:
    """The unweighted entropy score of two arrays, as ``scores`` has it for rows."""
    a, b = _share(p), _share(m)
    both = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    score = 1 - (2 * _array_entropy(both) - _array_entropy(b) - _array_entropy(a)) / math.log(4.0)
    return F.when((F.size(p) >= LEAST) & (F.size(F.filter(m, lambda x: x != 0)) >= LEAST), score).otherwise(0.0)


def bootstrap(matches: DataFrame, replicates: int = 500, share: float = 0.5) -> DataFrame:
    """Median entropy score over replicates of a random part of the fragments; the choice is a hash (MD5) of psm, fragment and replicate.

    The fragments of a match, a few dozen, meet in one array, and its replicates are evaluated in its row: nothing but
    the fragments is shuffled.
    """
    held = matches.groupBy("psm").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("p").cast("double").alias("p"), F.col("m").cast("double").alias("m")))).alias("f"))
    take = F.ceil(F.size("f") * F.lit(share)).cast("int")

    def replicate(r: Column) -> Column:
        named = lambda f: F.struct(F.md5(F.concat_ws("|", F.col("psm").cast("string"), f["pos"].cast("string"), r.cast("string"))).alias("h"), f["pos"].alias("pos"), f["p"].alias("p"), f["m"].alias("m"))
        return F.slice(F.array_sort(F.transform("f", named)), F.lit(1), take)

    rows = held.select("psm", "f", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).select("psm", replicate(F.col("replicate")).alias("part"))
    rows = rows.select("psm", F.transform("part", lambda f: f["p"]).alias("p"), F.transform("part", lambda f: f["m"]).alias("m"))
    return rows.select("psm", array_entropy_score(F.col("p"), F.col("m")).alias("score")).groupBy("psm").agg(F.percentile("score", F.lit(0.5)).alias("bootstrap_similarity"))


def ion_shares(rows: DataFrame, value: str, ions: list[str]) -> DataFrame:
    """Share of each ion type in the summed value: one column per ion."""
    total = F.sum(value)
    cols = [F.when(total > 0, F.sum(F.when(F.col("ion_type") == i, F.col(value)).otherwise(0.0)) / total).otherwise(0.0).alias(i) for i in ions]
    return rows.groupBy("psm").agg(*cols)
