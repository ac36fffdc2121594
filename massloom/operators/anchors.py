"""Calibration anchors, linear fits, retention-time and mobility bins, as-of lookups.

Anchor and PSM tables hold all runs at once; ``run`` (and charge, mass group) is a grouping column, never a loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.ranks import first_rows, group_ranks

FLT_MAX = 3.4028234663852886e38
MOST_ANCHORS = 5000  #: of a group of retention times in a fit
CUTOFF, RELAXED, FEWEST = 10**-3.5, 0.01, 10


def select(psms: DataFrame, *, predicted: str = "pred_rt", measured: str = "exp_rt", cutoff: float = CUTOFF) -> DataFrame:
    """Candidates: e-value at most ``cutoff``, a prediction (not 0) and a measured value that is a number."""
    return psms.filter((F.col("evalue") <= cutoff) & (F.col(predicted) != 0) & F.col(measured).isNotNull() & ~F.isnan(measured))


def relax(psms: DataFrame, by: tuple[str, ...] = ("run",), *, cutoff: float = CUTOFF, relaxed: float = RELAXED, fewest: int = FEWEST, **columns) -> DataFrame:
    """As ``select``; groups with fewer than ``fewest`` anchors fall back to the relaxed cutoff and then keep ``fewest`` at most.

    Groups are counted by an aggregate; only those with few anchors are ranked, and cut before they are shuffled.
    """
    wide = select(psms, cutoff=max(cutoff, relaxed), **columns)
    strict = F.col("evalue") <= cutoff
    counts = wide.groupBy(*by).agg(F.count_if(strict).alias("__strict"))
    many = wide.filter(strict).join(counts.filter(F.col("__strict") >= fewest), list(by), "left_semi")
    few = wide.join(counts.filter(F.col("__strict") < fewest), list(by), "left_semi")
    return many.unionByName(first_rows(few, fewest, by, ("evalue", "psm_id")).select(*many.columns))


def dedupe(anchors: DataFrame, by: tuple[str, ...] = ("run", "peptide", "charge"), order: tuple[str, ...] = ("scan_num", "psm_id")) -> DataFrame:
    """One PSM per precursor: the lowest e-value; of several ties, the one in their middle (index ties // 2) in scan order."""
    best = anchors.withColumn("__best", F.min("evalue").over(Window.partitionBy(*by))).filter(F.col("evalue") == F.col("__best"))
    group = Window.partitionBy(*by)
    rows = best.withColumns({"__n": F.count("*").over(group), "__r": F.row_number().over(group.orderBy(*order))})
    return rows.filter(F.col("__r") == F.floor(F.col("__n") / 2) + 1).drop("__best", "__n", "__r")


def top_n(anchors: DataFrame, n: int, by: tuple[str, ...] = ("run",), order: tuple[str, ...] = ("evalue", "psm_id")) -> DataFrame:
    """The n lowest e-values of each group, in file order among equals."""
    return first_rows(anchors, n, by, order)


def linear_fit(anchors: DataFrame, by: tuple[str, ...] = ("run",), x: str = "exp_rt", y: str = "pred_rt") -> DataFrame:
    """slope and intercept of y on x in each group."""
    return anchors.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def delta_linear(psms: DataFrame, fits: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    return psms.join(fits.select(*by, "slope", "intercept"), list(by), "left").withColumn("delta", F.abs(F.col("intercept") + F.col("slope") * F.col("exp_rt") - F.col("pred_rt")))


def outlier_mask(anchors: DataFrame, by: tuple[str, ...] = ("run",), x: tuple[str, ...] = ("exp_rt", "psm_id"), y: str = "pred_rt", most: int = MOST_ANCHORS) -> DataFrame:
    """Groups of 50 or more lose the anchors that lie under the 75th percentile of their rank window by more than 0.18 of the range.

    Groups are first cut to the ``most`` anchors of a fit, so that the neighbours of a group are at most most^2 / 40. The window is max(20, n / 80) ranks to each side. A frame of a window function has fixed bounds, so the rows are
    matched with their neighbours by rank blocks: an equality join on block numbers, then the rank condition.
    """
    anchors = top_n(anchors, most, by)
    spread = anchors.groupBy(*by).agg((F.max(y) - F.min(y)).alias("range"))
    rows = group_ranks(anchors.select(*dict.fromkeys(["psm_id", *by, *x, y])), by, x, "r", "n").join(spread, list(by))
    rows = rows.withColumn("half", F.greatest(F.lit(20), F.floor(F.col("n") / 80)).cast("int")).withColumn("block", F.floor(F.col("r") / F.col("half")).cast("int"))
    near = rows.select(*by, F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"), F.col("r").alias("at"), F.col(y).alias("value"))
    small = rows.filter("n < 50 or range <= 0")
    large = rows.filter("n >= 50 and range > 0").join(near, [*by, "block"]).filter(F.abs(F.col("r") - F.col("at")) <= F.col("half"))
    keys = ["psm_id", *by]
    high = large.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("values"), F.first(y).alias("y"), F.first("range").alias("range"))
    high = high.withColumn("high", F.element_at("values", (F.floor((F.size("values") - 1) * 0.75) + 1).cast("int")))
    ok = high.filter(F.col("y") >= F.col("high") - 0.18 * F.col("range")).select(*keys).unionByName(small.select(*keys))
    return anchors.join(ok, keys, "left_semi")


#: Tokens of mass groups that are words, at most: they are a parameter and become literals.
MOST_WORDS = 1000


def mass_groups(psms: DataFrame, groups: DataFrame, *, tolerance: float = 1e-3, exclusive: bool = False) -> DataFrame:
    """(psm_id, group_key): a PSM belongs to a group if one of its delta masses is within ``tolerance`` of one of the group's.

    groups: group_key, tokens array<string>. A token that is no number matches as part of the peptide, the empty token
    matches all; ``others`` takes the PSMs of no other group. With ``exclusive``, single-token groups leave out PSMs that a
    group of several tokens matches. Masses meet by an equality join on buckets of the tolerance's width, of which a delta
    visits three; words (at most MOST_WORDS) are looked for in each row.
    """
    tokens = groups.filter("group_key <> 'others'").select("group_key", F.size("tokens").alias("width"), F.explode("tokens").alias("token")).withColumn("mass", F.expr("try_cast(token as double)"))
    bucket = lambda mass: F.floor(mass / tolerance)
    masses = tokens.filter("mass is not null").select("group_key", "width", "mass", bucket(F.col("mass")).alias("bucket"))
    deltas = psms.select("psm_id", F.explode("deltas").alias("delta")).filter("delta is not null")
    deltas = deltas.select("psm_id", "delta", F.explode(F.sequence(bucket(F.col("delta")) - 1, bucket(F.col("delta")) + 1)).alias("bucket"))
    found = deltas.join(masses, "bucket").filter(F.abs(F.col("delta") - F.col("mass")) <= tolerance).select("psm_id", "group_key", "width")
    words = tokens.filter("mass is null").select("group_key", "width", "token").distinct().limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in mass groups")
    if words:
        known = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in r.asDict().items())) for r in sorted(words)))
        said = F.filter(known, lambda w: F.instr(F.col("peptide"), w["token"]) > 0)
        found = found.unionByName(psms.select("psm_id", F.explode(said).alias("w")).select("psm_id", "w.group_key", "w.width"))
    found = found.distinct()
    if exclusive:
        several = found.filter("width > 1").select("psm_id").distinct()
        found = found.filter("width > 1").unionByName(found.filter("width = 1").join(several, "psm_id", "left_anti"))
    rest = psms.select("psm_id").join(found, "psm_id", "left_anti").withColumn("group_key", F.lit("others"))
    return found.select("psm_id", "group_key").unionByName(rest)


def intervals(table: DataFrame, by: tuple[str, ...], x: str, y: str) -> DataFrame:
    """The (x, y) table as intervals [x0, x1) with the y at both ends, for as-of lookups."""
    w = Window.partitionBy(*by).orderBy(x)
    return table.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), (F.row_number().over(w) == 1).alias("first"))


def inverse_lookup(rows: DataFrame, table: DataFrame, by: tuple[str, ...], value: str, x: str, y: str, buckets: int = 512) -> DataFrame:
    """Adds ``looked_up``: y at ``value`` by linear interpolation in the group's table, the end values outside, the entry itself on an exact hit.

    An interval join by buckets of the group's range: a value visits one bucket, an interval those that it crosses.
    """
    steps = intervals(table, by, x, y)
    ends = table.groupBy(*by).agg(F.min(x).alias("__low"), F.max(x).alias("__high"), F.min_by(y, x).alias("__first"), F.max_by(y, x).alias("__last"))
    place = lambda v: F.coalesce(F.floor(F.try_divide((v - F.col("__low")) * buckets, F.col("__high") - F.col("__low"))), F.lit(0)).cast("int")
    spans = steps.filter("x1 is not null").join(ends, list(by)).select(*by, "x0", "x1", "y0", "y1", F.explode(F.sequence(place(F.col("x0")), place(F.col("x1")))).alias("__b"))
    probe = rows.join(ends, list(by), "left").withColumn("__b", place(F.least(F.greatest(F.col(value), F.col("__low")), F.col("__high"))))
    inside = (F.col(value) >= F.col("x0")) & (F.col(value) < F.col("x1"))
    same = [F.col(f"a.{b}") == F.col(f"b.{b}") for b in (*by, "__b")]
    cond = inside
    for s in same:
        cond &= s
    joined = probe.alias("a").join(spans.alias("b"), cond, "left")
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(value) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    found = F.when(F.col(value) <= F.col("__low"), F.col("__first")).when(F.col(value) >= F.col("__high"), F.col("__last")).otherwise(line)
    return joined.select(*(F.col(f"a.{c}") for c in rows.columns), found.alias("looked_up"))


def bins(psms: DataFrame, multiplier: float, measured: str = "exp_rt") -> DataFrame:
    """Adds ``bin`` (floor of measured * multiplier) and ``weight``: max(1, -ceil(log10 e-value)) copies of the PSM."""
    return psms.withColumns({"bin": F.floor(F.col(measured) * multiplier).cast("long"), "weight": F.greatest(F.lit(1), -F.ceil(F.log10("evalue"))).cast("int")})


def bin_stats(binned: DataFrame, by: tuple[str, ...] = ("run", "bin"), value: str = "pred_rt") -> DataFrame:
    """mean, sd and interquartile range (by index) of each bin over weighted copies; a single copy, or no spread, counts as FLT_MAX.

    Moments are partial aggregates. The quartiles are picked by running weight over the bin's distinct values, a window
    that spills, so no bin's values meet in one array.
    """
    w, v = F.when(F.col(value).isNotNull(), F.col("weight")).otherwise(0), F.col(value) - F.col("__base")
    bases = binned.groupBy(*by).agg(F.min(value).alias("__base"))  # sums of differences lose nothing to large values
    sums = binned.join(bases, list(by)).groupBy(*by).agg(F.sum("weight").cast("long").alias("n"), F.sum(w).alias("__n"), F.first("__base").alias("__base"), F.sum(w * v).alias("__s"), F.sum(w * v * v).alias("__ss"))
    mean = F.try_divide("__s", "__n")
    var = F.when(F.col("__n") > 1, F.greatest((F.col("__ss") - F.col("__s") * mean) / (F.col("__n") - 1), F.lit(0.0)))
    moments = sums.select(*by, "n", (F.col("__base") + mean).alias("mean"), F.sqrt(var).alias("sd"))
    points = binned.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.sum("weight").alias("__w"))
    group = Window.partitionBy(*by)
    ranked = points.withColumns({"__upto": F.sum("__w").over(group.orderBy("__v")), "__n": F.sum("__w").over(group)})
    at = lambda q: F.round(F.lit(q) * (F.col("__n") - 1))
    holds = lambda q: F.min(F.when(F.col("__upto") > at(q), F.col("__v")))
    quartiles = ranked.groupBy(*by).agg((holds(0.75) - holds(0.25)).alias("iqr"))
    wide = lambda c: F.when((F.col("n") == 1) | c.isNull() | (c == 0), F.lit(FLT_MAX)).otherwise(c)
    return moments.join(quartiles, list(by), "left").select(*by, "n", "mean", wide(F.col("sd")).alias("sd"), wide(F.col("iqr")).alias("iqr"))


def smooth(stats: DataFrame, mode: str = "reference", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """A moving average of +-1: over the triple (mean, sd, iqr) of one bin, or over neighbouring bins with ``across_bins``."""
    if mode == "across_bins":
        w = Window.partitionBy(*by).orderBy("bin").rowsBetween(-1, 1)
        return stats.withColumns({c: F.avg(c).over(w) for c in ("mean", "sd", "iqr")})
    m, s, i = F.col("mean"), F.col("sd"), F.col("iqr")
    return stats.withColumns({"mean": (m + s) / 2, "sd": (m + s + i) / 3, "iqr": (s + i) / 2})


def bin_deltas(binned: DataFrame, stats: DataFrame, by: tuple[str, ...] = ("run", "bin"), value: str = "pred_rt") -> DataFrame:
    """Adds delta (to the bin's mean) and zscore."""
    found = binned.join(stats.select(*by, "mean", "sd", "iqr"), list(by), "left")
    return found.withColumns({"delta": F.abs(F.col("mean") - F.col(value)), "zscore": F.abs((F.col(value) - F.col("mean")) / F.col("sd"))})


#: Of the density: order of the expansion, cells a bandwidth, and bandwidths beyond which the kernel is below 1e-14.
ORDER, CELLS, REACH = 10, 4, 8


def _transfer_table() -> list[tuple]:
    """steps, and for each pair of orders (j, k) the factor by which moment k of a cell adds to coefficient j of the cell that lies so many steps away.

    A Gaussian of z - u is the sum of u^k / k! He_k(z) exp(-z^2 / 2), with He_k the Hermite polynomials, and the
    derivative of He_k(z) exp(-z^2 / 2) is that of order k + 1 with the sign turned.
    """
    out = []
    for steps in range(-REACH * CELLS, REACH * CELLS + 1):
        z = steps / CELLS
        he = [1.0, z]
        for k in range(1, 2 * ORDER):
            he.append(z * he[k] - k * he[k - 1])
        out.append((steps, [[(-1) ** j * he[j + k] * math.exp(-z * z / 2) / (math.factorial(j) * math.factorial(k)) for k in range(ORDER + 1)] for j in range(ORDER + 1)]))
    return out


def density(psms: DataFrame, members: DataFrame, stats: DataFrame, by: tuple[str, ...], value: str = "pred_rt", bandwidth: float | None = None) -> DataFrame:
    """Adds probability: a Gaussian kernel density of the bin's values at the PSM's value.

    members: by, value and weight. The bandwidth is 1.36374 * min(sd, iqr / 1.34) * n^-0.2 unless given; an empty bin
    has 0. The values of a bin are gathered as moments on a grid of a quarter of its bandwidth, the moments of each cell
    are added to a polynomial of every cell within reach of the kernel, and a PSM evaluates that of its own cell: work is
    linear in rows and cells, no row meets the values of its bin, and keys are cells, so a large bin is many keys. With
    polynomials of order 10 the result is the direct sum's to 12 digits of the kernel's height.
    """
    spread = F.least("sd", F.col("iqr") / 1.34)
    h = F.lit(bandwidth) if bandwidth else 1.36374 * F.when(spread > 1e30, F.lit(1.0)).otherwise(spread) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    wide = stats.select(*by, "n", h.alias("h"))
    cell = F.floor(F.col(value) * CELLS / F.col("h") + 0.5)
    away = F.col(value) / F.col("h") - F.col("__cell") / CELLS  # within an eighth of a bandwidth
    placed = lambda rows: rows.join(wide, list(by)).filter(F.col(value).isNotNull()).withColumn("__cell", cell).withColumn("__u", away)

    power = lambda k: F.lit(1.0) if k == 0 else F.pow("__u", F.lit(float(k)))
    moments = placed(members.select(*by, value, "weight")).groupBy(*by, "__cell").agg(*(F.sum(F.col("weight") * power(k)).alias(f"__m{k}") for k in range(ORDER + 1)))
    table = members.sparkSession.createDataFrame(_transfer_table(), "steps long, factors array<array<double>>")  # 65 rows
    reach = F.explode(F.sequence(F.lit(-REACH * CELLS).cast("long"), F.lit(REACH * CELLS).cast("long")))
    sent = moments.withColumn("steps", reach).join(F.broadcast(table), "steps").withColumn("__cell", F.col("__cell") + F.col("steps"))
    term = lambda j: sum((F.col(f"__m{k}") * F.col("factors")[j][k] for k in range(1, ORDER + 1)), F.col("__m0") * F.col("factors")[j][0])
    local = sent.groupBy(*by, "__cell").agg(*(F.sum(term(j)).alias(f"__l{j}") for j in range(ORDER + 1)))

    asked = placed(psms.select("psm_id", *by, value)).join(local, [*by, "__cell"], "left")
    found = F.col(f"__l{ORDER}")
    for j in reversed(range(ORDER)):
        found = found * F.col("__u") + F.col(f"__l{j}")
    known = asked.select("psm_id", F.greatest(found / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * math.pi))), F.lit(0.0)).alias("probability"))
    return psms.select("psm_id").join(known, "psm_id", "left").select("psm_id", F.coalesce("probability", F.lit(0.0)).alias("probability"))


def uniform_prior(probabilities: DataFrame, sizes: DataFrame, uniform: float, by: tuple[str, ...]) -> DataFrame:
    """Adds prior: w1 * uniform + w2 * probability, the weights from the bin's size n and the 10th percentile of the bin sizes (by index)."""
    ranked = sizes.groupBy("n").count().withColumn("upto", F.sum("count").over(Window.orderBy("n")))
    total = ranked.agg(F.sum("count").alias("t"))
    tenth = ranked.crossJoin(F.broadcast(total)).filter(F.col("upto") > F.floor(F.col("t") * 0.1)).agg(F.min("n").alias("prior_size"))
    found = probabilities.join(sizes.select(*by, "n"), list(by), "left").crossJoin(F.broadcast(tenth))
    n = F.coalesce("n", F.lit(0))
    return found.withColumn("prior", (F.col("prior_size") * uniform + n * F.col("probability")) / (F.col("prior_size") + n)).drop("n", "prior_size")


def peptide_counts(psms: DataFrame, least: float = 10.0) -> DataFrame:
    """In how many runs each peptide has a score above ``least``."""
    return psms.groupBy("peptide").agg(F.count_distinct(F.when(F.col("hyperscore") > least, F.col("run"))).alias("runs"))


def last_rt(psms: DataFrame, by: Column | str = "run") -> DataFrame:
    return psms.groupBy(by).agg(F.max("exp_rt").alias("last_rt"))


def rt_error_filter(psms: DataFrame, delta: str, limit: float, percent: bool = False) -> DataFrame:
    """PSMs whose delta is at most ``limit``, minutes or percent of the run's last retention time."""
    if not percent:
        return psms.filter(F.col(delta) <= limit)
    return psms.join(last_rt(psms), "run").filter(F.col(delta) <= F.col("last_rt") * (limit / 100)).drop("last_rt")


def wash_cutoff(psms: DataFrame, n: int = 100) -> DataFrame:
    """run, cutoff: the first empty bin after the fullest one of an n-bin histogram of retention time; twice the maximum without one."""
    ends = psms.groupBy(F.col("run").alias("__run")).agg(F.min("exp_rt").alias("low"), F.max("exp_rt").alias("high"))
    rows = psms.select("run", "exp_rt").join(ends, F.col("run").eqNullSafe(F.col("__run")))
    step = (F.col("high") - F.col("low")) / n
    at = F.least(F.lit(n - 1), F.floor(F.try_divide(F.col("exp_rt") - F.col("low"), step))).cast("int")
    counts = rows.groupBy("run", "low", "high", F.coalesce(at, F.lit(0)).alias("bin")).count()
    filled = counts.groupBy("run", "low", "high").agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("mode"), F.collect_set("bin").alias("seen"))
    empty = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: (b > F.col("mode")) & ~F.array_contains("seen", b))
    return filled.select("run", F.when(F.size(empty) > 0, F.col("low") + F.array_min(empty) * step).otherwise(2 * F.col("high")).alias("cutoff"))
