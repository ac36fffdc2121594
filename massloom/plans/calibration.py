"""Queries over search results: anchors, fits, bins, model selection and summaries (sections D8, D9, G, H and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.operators import anchors, models, qc
from massloom.plans.adapters import PSM, psm, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, body: str | None = None, *views: str):
    def keep(fn):
        QUERIES[name] = fn
        if body:
            ORACLES[name] = with_views(body, PSM, *views)
        return fn

    return keep


TILT = 1.3e-9  #: breaks ties of decimal fractions the same way in both engines


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def tilted(df, *names):
    return df.withColumns({n: F.round(F.col(n) + TILT, 6) for n in names})


CUT = "power(10.0::double, -3.5::double)"
SEL = f"sel as (select * from psm where evalue <= {CUT} and pred_rt <> 0)"
DED = """ded as (select * exclude (best, n, r) from (select *, count(*) over (partition by run, peptide, charge) as n, row_number() over (partition by run, peptide, charge order by scan_num, psm_id) as r
  from (select *, min(evalue) over (partition by run, peptide, charge) as best from sel) where evalue = best) where r = floor(n/2) + 1)"""


@register("anchor_select", "select psm_id, run from sel", SEL)
def anchor_select(spark, sf_dir):
    return anchors.select(psm(spark, sf_dir)).select("psm_id", "run")


@register(
    "anchor_relax",
    f"""select psm_id, run, peptide from (select *, count(*) filter (evalue <= {CUT}) over (partition by run, peptide) as strict, row_number() over (partition by run, peptide order by evalue, psm_id) as r
from psm where evalue <= 0.01 and pred_rt <> 0) where case when strict >= 10 then evalue <= {CUT} else r <= 10 end""",
)
def anchor_relax(spark, sf_dir):
    return anchors.relax(psm(spark, sf_dir), ("run", "peptide")).select("psm_id", "run", "peptide")


@register("anchor_dedupe", "select psm_id, run, peptide, charge from ded", SEL, DED)
def anchor_dedupe(spark, sf_dir):
    return anchors.dedupe(anchors.select(psm(spark, sf_dir))).select("psm_id", "run", "peptide", "charge")


@register("anchor_top_n", "select psm_id, run from sel qualify row_number() over (partition by run order by evalue, psm_id) <= 5000", SEL)
def anchor_top_n(spark, sf_dir):
    return anchors.top_n(anchors.select(psm(spark, sf_dir)), anchors.MOST_ANCHORS).select("psm_id", "run")


FIT = "fit as (select run, regr_slope(pred_rt, exp_rt) as slope, regr_intercept(pred_rt, exp_rt) as intercept, count(*) as n from sel group by run)"


@register("linear_fit", "select run, round(slope, 6) as slope, round(intercept, 6) as intercept, n from fit", SEL, FIT)
def linear_fit(spark, sf_dir):
    return rounded(anchors.linear_fit(anchors.select(psm(spark, sf_dir))), "slope", "intercept")


@register("delta_rt_linear", "select psm_id, round(abs(intercept + slope*exp_rt - pred_rt), 6) as delta from psm left join fit using (run)", SEL, FIT)
def delta_rt_linear(spark, sf_dir):
    rows = psm(spark, sf_dir)
    return rounded(anchors.delta_linear(rows, anchors.linear_fit(anchors.select(rows))), "delta").select("psm_id", "delta")


@register(
    "outlier_mask",
    """, r as (select *, row_number() over (partition by run order by exp_rt, psm_id) as r, count(*) over (partition by run) as n, max(pred_rt) over (partition by run) - min(pred_rt) over (partition by run) as rng
  from (select * from ded qualify row_number() over (partition by run order by evalue, psm_id) <= 5000)),
w as (select a.psm_id, a.pred_rt as y, a.rng, list(b.pred_rt order by b.pred_rt) as v from r a join r b on a.run = b.run and abs(a.r - b.r) <= greatest(20, floor(a.n/80)) group by all)
select psm_id from w where y >= v[cast(floor((len(v) - 1)*0.75) as int) + 1] - 0.18::double*rng""",
    SEL,
    DED,
)
def outlier_mask(spark, sf_dir):
    return anchors.outlier_mask(anchors.dedupe(anchors.select(psm(spark, sf_dir)))).select("psm_id")


# Mass groups: delta masses from the last digits of the line item key.
DELTAS = "dm as (select psm_id, peptide, case psm_id % 5 when 0 then [79.9664::double] when 1 then [79.9568::double, 15.9949::double] when 2 then [-14.0157::double] when 3 then [42.0157::double, 79.9660::double] else []::double[] end as deltas from psm)"
GROUP_ROWS = [("phospho", ["79.9663"]), ("oxi&methyl", ["15.9949", "14.0157"]), ("word", ["PEP1"]), ("others", [])]
FOUND = """tok as (select * from (values ('phospho', '79.9663'), ('oxi&methyl', '15.9949'), ('oxi&methyl', '14.0157'), ('word', 'PEP1')) t(group_key, token)),
found as (select distinct psm_id, group_key from dm, tok where list_has_any(list_transform(deltas, lambda d: abs(d - coalesce(try_cast(token as double), 1e9)) <= 1e-3), [true]) or (try_cast(token as double) is null and contains(peptide, token)))"""


def with_deltas(spark, sf_dir):
    k = F.col("psm_id") % 5
    arr = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<double>")
    deltas = F.when(k == 0, arr(79.9664)).when(k == 1, arr(79.9568, 15.9949)).when(k == 2, arr(-14.0157)).when(k == 3, arr(42.0157, 79.9660)).otherwise(arr())
    return psm(spark, sf_dir).withColumn("deltas", deltas)


@register("mass_group_join", "select * from found union all select psm_id, 'others' from psm where psm_id not in (select psm_id from found)", DELTAS, FOUND)
def mass_group_join(spark, sf_dir):
    return anchors.mass_groups(with_deltas(spark, sf_dir), spark.createDataFrame(GROUP_ROWS, "group_key string, tokens array<string>"))


@register(
    "mass_group_exclusive",
    "select * from found where group_key = 'oxi&methyl' or psm_id not in (select psm_id from found where group_key = 'oxi&methyl') union all select psm_id, 'others' from psm where psm_id not in (select psm_id from found)",
    DELTAS,
    FOUND,
)
def mass_group_exclusive(spark, sf_dir):
    return anchors.mass_groups(with_deltas(spark, sf_dir), spark.createDataFrame(GROUP_ROWS, "group_key string, tokens array<string>"), exclusive=True)


# As-of lookups: the table holds each run's mean time at every whole predicted value.
TAB = "tab as (select run, cast(floor(pred_rt/2)*2 as double) as y, avg(exp_rt) as x from psm where label = 1 group by 1, 2)"
STEP = "step as (select run, y as y0, x as x0, lead(y) over w as y1, lead(x) over w as x1 from tab window w as (partition by run order by y)), ends as (select run, min(y) as low, max(y) as high, arg_min(x, y) as first, arg_max(x, y) as last from tab group by run)"
LOOKED = """looked as (select p.*, case when pred_rt <= low then first when pred_rt >= high then last else x0 + (x1 - x0)*(pred_rt - y0)/(y1 - y0) end as looked_up
from psm p left join ends using (run) left join step s on s.run = p.run and p.pred_rt >= y0 and p.pred_rt < y1)"""


def looked(spark, sf_dir):
    rows = psm(spark, sf_dir)
    table = rows.filter("label = 1").groupBy("run", (F.floor(F.col("pred_rt") / 2) * 2).cast("double").alias("y")).agg(F.avg("exp_rt").alias("x"))
    return anchors.inverse_lookup(rows, table, ("run",), "pred_rt", "y", "x")


@register("inverse_lookup", "select psm_id, round(looked_up + 1.3e-9, 6) as looked_up from looked", TAB, STEP, LOOKED)
def inverse_lookup(spark, sf_dir):
    return tilted(looked(spark, sf_dir), "looked_up").select("psm_id", "looked_up")


@register("pred_rt_real_units", "select psm_id, round(looked_up + 1.3e-9, 6) as pred_rt_real_units, round(abs(exp_rt - looked_up) + 1.3e-9, 6) as delta_rt_loess_real from looked", TAB, STEP, LOOKED)
def pred_rt_real_units(spark, sf_dir):
    rows = looked(spark, sf_dir)
    return rows.select("psm_id", F.round(F.col("looked_up") + TILT, 6).alias("pred_rt_real_units"), F.round(F.abs(F.col("exp_rt") - F.col("looked_up")) + TILT, 6).alias("delta_rt_loess_real"))


@register("delta_rt_loess_real", "select psm_id, round(abs(exp_rt - looked_up) + 1.3e-9, 6) as delta_rt_loess_real from looked", TAB, STEP, LOOKED)
def delta_rt_loess_real(spark, sf_dir):
    return looked(spark, sf_dir).select("psm_id", F.round(F.abs(F.col("exp_rt") - F.col("looked_up")) + TILT, 6).alias("delta_rt_loess_real"))


@register("calibrated_anchor_pairs", "select psm_id, round(looked_up + 1.3e-9, 6) as calibrated, round(looked_up - exp_rt + 1.3e-9, 6) as residual from looked where psm_id in (select psm_id from ded)", SEL, DED, TAB, STEP, LOOKED)
def calibrated_anchor_pairs(spark, sf_dir):
    best = anchors.dedupe(anchors.select(psm(spark, sf_dir))).select("psm_id")
    rows = looked(spark, sf_dir).join(best, "psm_id", "left_semi")
    return rows.select("psm_id", F.round(F.col("looked_up") + TILT, 6).alias("calibrated"), F.round(F.col("looked_up") - F.col("exp_rt") + TILT, 6).alias("residual"))


def _bins(key: str, mult: str) -> str:
    return f"b as (select *, cast(floor(exp_rt*{mult}) as bigint) as bin, cast(greatest(1, -ceil(log10(evalue))) as int) as weight from psm), c as (select {key} bin, pred_rt, unnest(range(weight)) as i from b)"


def _stats(key: str) -> str:
    wide = lambda x: f"case when n = 1 or {x} is null or {x} = 0 then 3.4028234663852886e38 else {x} end"
    return f"""s as (select {key} bin, n, mean, {wide('sd0')} as sd, {wide('(v[cast(round(0.75::double*(n-1)) as int)+1] - v[cast(round(0.25::double*(n-1)) as int)+1])')} as iqr
from (select {key} bin, count(*) as n, avg(pred_rt) as mean, stddev_samp(pred_rt) as sd0, list(pred_rt order by pred_rt) as v from c group by all))"""


RT_B, RT_S = _bins("run,", "1.0::double"), _stats("run,")
IM_B, IM_S = _bins("run, charge,", "100.0::double"), _stats("run, charge,")


def rt_bins(spark, sf_dir):
    return anchors.bins(psm(spark, sf_dir), 1.0)


@register("rt_bins", "select run, bin, count(*) as copies, round(sum(pred_rt), 6) as total from c group by run, bin", RT_B)
def rt_bins_query(spark, sf_dir):
    return rt_bins(spark, sf_dir).groupBy("run", "bin").agg(F.sum("weight").alias("copies"), F.round(F.sum(F.col("pred_rt") * F.col("weight")), 6).alias("total"))


@register("im_bins", "select run, charge, bin, count(*) as copies, round(sum(pred_rt), 6) as total from c group by run, charge, bin", IM_B)
def im_bins(spark, sf_dir):
    rows = anchors.bins(psm(spark, sf_dir), 100.0)
    return rows.groupBy("run", "charge", "bin").agg(F.sum("weight").alias("copies"), F.round(F.sum(F.col("pred_rt") * F.col("weight")), 6).alias("total"))


@register("bin_stats", "select run, bin, n, round(mean + 1.3e-9, 6) as mean, round(sd + 1.3e-9, 6) as sd, round(iqr + 1.3e-9, 6) as iqr from s", RT_B, RT_S)
def bin_stats(spark, sf_dir):
    return tilted(anchors.bin_stats(rt_bins(spark, sf_dir)), "mean", "sd", "iqr")


@register("stat_smoothing", "select run, bin, n, round((mean+sd)/2 + 1.3e-9, 6) as mean, round((mean+sd+iqr)/3 + 1.3e-9, 6) as sd, round((sd+iqr)/2 + 1.3e-9, 6) as iqr from s", RT_B, RT_S)
def stat_smoothing(spark, sf_dir):
    return tilted(anchors.smooth(anchors.bin_stats(rt_bins(spark, sf_dir))), "mean", "sd", "iqr")


@register("stat_smoothing_across_bins", "select run, bin, n, round(avg(mean) over w + 1.3e-9, 6) as mean, round(avg(sd) over w + 1.3e-9, 6) as sd, round(avg(iqr) over w + 1.3e-9, 6) as iqr from s window w as (partition by run order by bin rows between 1 preceding and 1 following)", RT_B, RT_S)
def stat_smoothing_across_bins(spark, sf_dir):
    return tilted(anchors.smooth(anchors.bin_stats(rt_bins(spark, sf_dir)), "across_bins"), "mean", "sd", "iqr")


@register("delta_rt_bins", "select psm_id, round(abs(mean - pred_rt) + 1.3e-9, 6) as delta_rt_bins, round(abs((pred_rt - mean)/sd) + 1.3e-9, 6) as rt_zscore from b left join s using (run, bin)", RT_B, RT_S)
def delta_rt_bins(spark, sf_dir):
    binned = rt_bins(spark, sf_dir)
    found = anchors.bin_deltas(binned, anchors.bin_stats(binned))
    return found.select("psm_id", F.round(F.col("delta") + TILT, 6).alias("delta_rt_bins"), F.round(F.col("zscore") + TILT, 6).alias("rt_zscore"))


@register("rt_zscore", "select psm_id, round(abs((pred_rt - mean)/sd) + 1.3e-9, 6) as rt_zscore from b left join s using (run, bin)", RT_B, RT_S)
def rt_zscore(spark, sf_dir):
    binned = rt_bins(spark, sf_dir)
    return anchors.bin_deltas(binned, anchors.bin_stats(binned)).select("psm_id", F.round(F.col("zscore") + TILT, 6).alias("rt_zscore"))


def _kde(key: str) -> str:
    k = key.replace(",", "").split()
    using = ", ".join([*k, "bin"])
    return f"""q as (select psm_id, {key} cast(round(exp_rt{'*100' if 'charge' in key else ''}) as bigint) as bin, pred_rt from psm),
h as (select {key} bin, n, 1.36374::double*case when least(sd, iqr/1.34::double) > 1e30 then 1 else least(sd, iqr/1.34::double) end*power(n, -0.2::double) as h from s),
pts as (select {key} bin, pred_rt as v, count(*) as w from c group by all),
prob as (select psm_id, {key} bin, coalesce(sum(exp(-0.5*power((pred_rt - v)/h, 2))*w)/any_value(n*h*sqrt(2*3.141592653589793::double)), 0) as probability from q left join h using ({using}) left join pts using ({using}) group by all)"""


def _rounded_bins(spark, sf_dir, mult):
    return psm(spark, sf_dir).withColumn("bin", F.round(F.col("exp_rt") * mult).cast("long"))


@register("rt_probability", "select psm_id, round(probability, 6) as rt_probability from (select psm_id, max(probability) as probability from prob group by psm_id)", RT_B, RT_S, _kde("run,"))
def rt_probability(spark, sf_dir):
    binned = rt_bins(spark, sf_dir)
    found = anchors.density(_rounded_bins(spark, sf_dir, 1), binned, anchors.bin_stats(binned), ("run", "bin"))
    return found.select("psm_id", F.round("probability", 6).alias("rt_probability"))


@register("im_probability", "select psm_id, round(probability, 6) as im_probability from (select psm_id, max(probability) as probability from prob group by psm_id)", IM_B, IM_S, _kde("run, charge,"))
def im_probability(spark, sf_dir):
    binned = anchors.bins(psm(spark, sf_dir), 100.0)
    by = ("run", "charge", "bin")
    found = anchors.density(_rounded_bins(spark, sf_dir, 100), binned, anchors.bin_stats(binned, by), by)
    return found.select("psm_id", F.round("probability", 6).alias("im_probability"))


@register(
    "probability_unif_prior",
    """, t as (select n from (select n, row_number() over (order by n) as r, count(*) over () as m from s) qualify row_number() over (order by case when r > floor(m*0.1::double) then 0 else 1 end, n) = 1)
select psm_id, round((t.n*0.01::double + coalesce(s.n, 0)*probability)/(t.n + coalesce(s.n, 0)), 6) as prior from prob left join s using (run, bin), t""",
    RT_B,
    RT_S,
    _kde("run,"),
)
def probability_unif_prior(spark, sf_dir):
    binned = rt_bins(spark, sf_dir)
    stats = anchors.bin_stats(binned)
    placed = _rounded_bins(spark, sf_dir, 1)
    found = anchors.density(placed, binned, stats, ("run", "bin")).join(placed.select("psm_id", "run", "bin"), "psm_id")
    return rounded(anchors.uniform_prior(found, stats, 0.01, ("run", "bin")), "prior").select("psm_id", "prior")


@register("predicted_passthrough", "select psm_id, round(pred_rt, 6) as predicted_rt, round(exp_rt/10, 6) as ion_mobility from psm")
def predicted_passthrough(spark, sf_dir):
    return psm(spark, sf_dir).select("psm_id", F.round("pred_rt", 6).alias("predicted_rt"), F.round(F.col("exp_rt") / 10, 6).alias("ion_mobility"))


def _passed(name: str, sql: str) -> None:
    """A measured or predicted value that goes to the output as it is."""

    @register(name, f"select psm_id, round({sql} + 1.3e-9, 6) as {name} from psm")
    def query(spark, sf_dir):
        return psm(spark, sf_dir).select("psm_id", F.round(F.expr(sql) + TILT, 6).alias(name))


_passed("predicted_rt", "pred_rt")
_passed("predicted_im", "exp_rt/100 + pred_rt/5000")
_passed("ion_mobility", "exp_rt/100")


@register("peptide_counts", "select peptide, count(distinct case when hyperscore > 10 then run end) as runs from psm group by peptide")
def peptide_counts(spark, sf_dir):
    return anchors.peptide_counts(psm(spark, sf_dir))


@register("rt_error_filter", "select psm_id from psm p join (select run, max(exp_rt) as last_rt from psm group by run) using (run) where abs(exp_rt - pred_rt/2) <= last_rt*(10.0::double/100)")
def rt_error_filter(spark, sf_dir):
    rows = psm(spark, sf_dir).withColumn("delta", F.abs(F.col("exp_rt") - F.col("pred_rt") / 2))
    return anchors.rt_error_filter(rows, "delta", 10.0, percent=True).select("psm_id")


@register(
    "wash_cutoff",
    """, e as (select run, min(exp_rt) as low, max(exp_rt) as high from psm group by run),
h as (select run, low, high, least(99, cast(floor((exp_rt - low)/((high - low)/100)) as int)) as bin, count(*) as n from psm join e using (run) group by all),
m as (select run, low, high, first(bin order by n desc, bin) as mode from h group by all),
g as (select m.run, min(b) as gap from m, range(100) t(b) where b > mode and not exists (select 1 from h where h.run = m.run and h.bin = b) group by m.run)
select m.run, round(case when gap is null then 2*high else low + gap*((high - low)/100) end, 6) as cutoff from m left join g using (run)""",
)
def wash_cutoff(spark, sf_dir):
    return rounded(anchors.wash_cutoff(psm(spark, sf_dir)), "cutoff")


# Model selection: the model is a digit of the peptide, the score a similarity, the energy a part of the scan number.
SCORED = "scored as (select concat('m', cast(try_cast(substr(peptide, 4) as int) % 5 as varchar)) as model, 20 + scan_num % 21 as energy, 1/(1 + abs(pred_rt - 2*exp_rt)) - 0.01::double as score, pred_rt - 2*exp_rt as residual, psm_id from psm)"
MODELS = [f"m{i}" for i in range(5)]


def scored(spark, sf_dir):
    rows = psm(spark, sf_dir)
    return rows.select(
        F.concat(F.lit("m"), (F.substring("peptide", 4, 10).cast("int") % 5).cast("string")).alias("model"),
        (20 + F.col("scan_num") % 21).alias("energy"),
        (1 / (1 + F.abs(F.col("pred_rt") - 2 * F.col("exp_rt"))) - 0.01).alias("score"),
        (F.col("pred_rt") - 2 * F.col("exp_rt")).alias("residual"),
        "psm_id",
    )


def _top(where: str) -> str:
    return f"""select psm_id from (select *, row_number() over (partition by run order by psm_id) as f from (
select *, max(case when e <= k then evalue end) over (partition by run) as cut from (
select *, row_number() over (partition by run order by evalue, psm_id) as e, ceil(1000.0/(select count(distinct run) from psm)) as k from psm where {where})) where evalue <= cut) where f <= k"""


@register("top_psms_per_run", _top("charge = 2"))
def top_psms_per_run(spark, sf_dir):
    return models.top_psms(psm(spark, sf_dir), 1000, charge=2).select("psm_id")


@register("top_decoys", _top("label = 0"))
def top_decoys(spark, sf_dir):
    return models.top_psms(psm(spark, sf_dir), 1000, label=0).select("psm_id")


@register("median_similarity", "select model, round(quantile_cont(score, 0.5), 6) as median from scored group by model", SCORED)
def median_similarity(spark, sf_dir):
    return rounded(models.median_scores(scored(spark, sf_dir)), "median")


@register("best_energy", "select model, energy, round(median, 6) as median from (select model, energy, quantile_cont(score, 0.5) as median from scored group by all) where median > 0 qualify row_number() over (partition by model order by median desc, energy) = 1", SCORED)
def best_energy(spark, sf_dir):
    return rounded(models.best_energy(scored(spark, sf_dir)), "median")


PADDED = "padded as (select model, score, row_number() over (partition by model order by score) as i from (select model, score from scored union all select model, -3.4028234663852886e38 from (select model, n, max(n) over () as m from (select model, count(*) as n from scored group by model)), lateral (select unnest(range(m - n)) as k)))"


@register("pad_scores", "select model, i, round(score, 6) as score from padded", SCORED, PADDED)
def pad_scores(spark, sf_dir):
    return rounded(models.padded(scored(spark, sf_dir)), "score").select("model", "i", "score")


@register("model_score_matrix", f"select i, {', '.join(f"round(max(case when model = '{m}' then score end), 6) as {m}" for m in MODELS)} from padded group by i", SCORED, PADDED)
def model_score_matrix(spark, sf_dir):
    return rounded(models.score_matrix(scored(spark, sf_dir), MODELS), *MODELS)


@register("consensus_vote", "select model, count(*) as votes from (select * from (select *, max(i) over (partition by model) - i + 1 as r from padded) where r <= 200 and score > 0 qualify row_number() over (partition by r order by score desc, model) = 1) group by model", SCORED, PADDED)
def consensus_vote(spark, sf_dir):
    return models.consensus(scored(spark, sf_dir), 200)


@register("rmse_rank", "select model, round(sqrt(avg(residual*residual)), 6) as rmse, row_number() over (order by sqrt(avg(residual*residual)), model) as place from scored group by model", SCORED)
def rmse_rank(spark, sf_dir):
    from pyspark.sql import Window

    found = models.rmse(scored(spark, sf_dir))
    return rounded(found.withColumn("place", F.row_number().over(Window.orderBy("rmse", "model")).cast("long")), "rmse")


# Summaries.


@register("score_histogram", "select label, least(99, cast(floor((v - low)*100/(high - low)) as int)) as bin, count(*) as count from (select label, log10(pred_rt + 0.01::double) as v from psm), (select min(log10(pred_rt + 0.01::double)) as low, max(log10(pred_rt + 0.01::double)) as high from psm) group by all")
def score_histogram(spark, sf_dir):
    return qc.score_histogram(psm(spark, sf_dir), qc.log_value(F.col("pred_rt")))


@register("integer_histogram", "select label, cast(floor(hyperscore) as int) as bin, count(*) as count from psm group by all")
def integer_histogram(spark, sf_dir):
    return qc.score_histogram(psm(spark, sf_dir), F.col("hyperscore"), integers=True)


@register("run_score_percentiles", "select *, row_number() over (order by p50, run) as place from (select run, max(n) as n, " + ", ".join(f"max(case when r = floor({k}) then pred_rt end) as {p}" for p, k in (("p5", "n/20"), ("p25", "n/4"), ("p50", "n/2"), ("p75", "3*n/4"), ("p95", "19*n/20"))) + " from (select run, pred_rt, row_number() over (partition by run order by pred_rt) - 1 as r, count(*) over (partition by run) as n from psm) group by run)")
def run_score_percentiles(spark, sf_dir):
    return qc.run_percentiles(psm(spark, sf_dir), "pred_rt")


@register(
    "abs_delta_trend",
    """, r as (select *, abs(exp_rt - pred_rt) as d, row_number() over (partition by run order by exp_rt, psm_id) - 1 as r, count(*) over (partition by run) as n from ded),
g as (select run, greatest(1, cast(floor(n/20) as bigint)) as bins, cast(floor(r*greatest(1, floor(n/20))/n) as int) as bin, quantile_cont(d, 0.5) as median, quantile_cont(d, 0.05) as p5, quantile_cont(d, 0.95) as p95, avg(exp_rt) as rt from r group by all)
select a.run, a.bin, round(avg(b.median) + 1.3e-9, 6) as median, round(avg(b.p5) + 1.3e-9, 6) as p5, round(avg(b.p95) + 1.3e-9, 6) as p95, round(any_value(a.rt) + 1.3e-9, 6) as rt
from g a join g b on a.run = b.run and abs(a.bin - b.bin) <= ceil(a.bins/60) group by a.run, a.bin""",
    SEL,
    DED,
)
def abs_delta_trend(spark, sf_dir):
    rows = anchors.dedupe(anchors.select(psm(spark, sf_dir))).withColumn("d", F.abs(F.col("exp_rt") - F.col("pred_rt")))
    return tilted(qc.delta_trend(rows, "d"), "median", "p5", "p95", "rt")


@register("filtered_score_lists", f"select psm_id, round(pred_rt, 6) as score, round(abs(exp_rt - pred_rt), 6) as delta from psm where evalue <= {CUT}")
def filtered_score_lists(spark, sf_dir):
    rows = psm(spark, sf_dir).filter(F.col("evalue") <= anchors.CUTOFF)
    return rows.select("psm_id", F.round("pred_rt", 6).alias("score"), F.round(F.abs(F.col("exp_rt") - F.col("pred_rt")), 6).alias("delta"))


@register("running_moments", "select run, count(pred_rt) as n, round(avg(pred_rt), 6) as mean, round(stddev_samp(pred_rt), 6) as sd, round(quantile_cont(floor(pred_rt/1e-4::double)*1e-4::double, 0.5), 4) as median from psm group by run")
def running_moments(spark, sf_dir):
    return rounded(rounded(qc.moments(psm(spark, sf_dir), "pred_rt"), "mean", "sd"), "median", digits=4)


@register("descriptive_stats", "select run, round(avg(pred_rt), 6) as mean, round(var_samp(pred_rt), 6) as variance, round(covar_samp(pred_rt, exp_rt), 6) as covariance, round(quantile_cont(pred_rt, 0.5), 6) as median, round(avg((pred_rt-exp_rt)*(pred_rt-exp_rt)), 6) as mse, round(sum((pred_rt-exp_rt)*(pred_rt-exp_rt)), 4) as rss from psm group by run")
def descriptive_stats(spark, sf_dir):
    return rounded(rounded(qc.descriptive(psm(spark, sf_dir), "pred_rt", "exp_rt"), "mean", "variance", "covariance", "median", "mse"), "rss", digits=4)


@register("moving_average", "select psm_id, round(avg(pred_rt) over (partition by run order by exp_rt, psm_id rows between 2 preceding and 2 following) + 1.3e-9, 6) as moving from psm")
def moving_average(spark, sf_dir):
    return tilted(qc.moving_average(psm(spark, sf_dir), "pred_rt", 2, ("run",), ("exp_rt", "psm_id")), "moving").select("psm_id", "moving")
