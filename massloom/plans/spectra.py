"""Queries over spectra and predicted fragments (sections D, E1-E4, E11 and F of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import ions
from massloom.functions.ions import PROTON, RESIDUES, WATER
from massloom.operators import library, match, similarity
from massloom.plans import adapters
from massloom.plans.adapters import FRAGS, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

KEPT = "kept as (select * from frags qualify row_number() over (partition by psm order by intensity desc, mz, pos) <= 20)"
WINDOW = "p.scan = k.scan and p.mz between k.mz*(1 - 20.0::double*1e-6::double) and k.mz*(1 + 20.0::double*1e-6::double)"
MATCHED = f"""matched as (
select k.psm, k.scan, k.pos, k.mz, k.ion_type, k.intensity as p, coalesce(max(p.intensity), 0) as m
from kept k left join peaks p on {WINDOW} group by all)"""
ALL_MATCHED = f"""theory as (
select k.psm, k.scan, k.pos, k.mz, k.ion_type, k.intensity as p, coalesce(max(p.intensity), 0) as m
from frags k left join peaks p on {WINDOW} group by all)"""
WEIGHTED = "wm as (select m.*, case when floor(mz/10) < 70 then (cast(floor(mz/10) as bigint)*7 % 10 + 1)/10.0::double else 0 end as w from matched m)"
NORM = """norm as (select *,
  case when count(*) over s = 1 then 1 when sum(p) over s > 0 then p/sum(p) over s else 0 end as p1,
  case when count(*) over s = 1 then 1 when sum(m) over s > 0 then m/sum(m) over s else 0 end as m1,
  case when sum(p*p) over s > 0 then p/sqrt(sum(p*p) over s) else 0 end as pu,
  case when sum(m*m) over s > 0 then m/sqrt(sum(m*m) over s) else 0 end as mu
from wm window s as (partition by psm))"""
UNITS = """units as (select *,
  case when sum(w*pu*w*pu) over s > 0 then w*pu/sqrt(sum(w*pu*w*pu) over s) else 0 end as pw,
  case when sum(w*mu*w*mu) over s > 0 then w*mu/sqrt(sum(w*mu*w*mu) over s) else 0 end as mw
from norm window s as (partition by psm))"""
RANKS = """ranks as (select *,
  rank() over (partition by psm order by p) + (count(*) over (partition by psm, p) - 1)/2 as pr,
  rank() over (partition by psm order by m) + (count(*) over (partition by psm, m) - 1)/2 as mr from units)"""
POWERS = """e as (select *, -sum(case when p1 <> 0 then p1*ln(p1) else 0 end) over (partition by psm) as ent from ranks),
e2 as (select *, case when ent < 1.75 then power(p, ent/2.75) else p1 end as pp, case when ent < 1.75 then power(m, ent/2.75) else m1 end as mp from e),
all_columns as (select *,
  case when count(*) over s = 1 then 1 when sum(pp) over s > 0 then pp/sum(pp) over s else 0 end as ph,
  case when count(*) over s = 1 then 1 when sum(mp) over s > 0 then mp/sum(mp) over s else 0 end as mh
from e2 window s as (partition by psm))"""
CHAIN = (FRAGS, KEPT, MATCHED, WEIGHTED, NORM, UNITS, RANKS, POWERS)


def ent(v: str) -> str:
    return f"(-sum(case when {v} <> 0 then ({v})*ln({v}) else 0 end))"


def entropy_score(a: str, b: str) -> str:
    return f"(case when count(*) >= 2 and sum(case when {b} <> 0 then 1 else 0 end) >= 2 then 1 - (2*{ent(f'(({a}+{b})/2)')} - {ent(b)} - {ent(a)})/ln(4.0::double) else 0 end)"


def cosine(w: str) -> str:
    return f"(case when count(*) < 2 or sqrt(sum(p*p*{w})*sum(m*m*{w})) = 0 then 0 else sum(p*m*{w})/sqrt(sum(p*p*{w})*sum(m*m*{w})) end)"


def angle(c: str) -> str:
    return f"(case when count(*) < 2 then 0 else 1 - 2*acos(least({c}, 1.0))/3.141592653589793 end)"


def guarded(few: str, none: str, matched: str, score: str) -> str:
    return f"(case when count(*) < 2 then {few} when sum({matched}) = 0 then {none} else {score} end)"


UNWEIGHTED = entropy_score("p1", "m1")
SCORES = {
    "cosine_similarity": cosine("1.0"),
    "weighted_cosine": cosine("w"),
    "spectral_contrast_angle": angle(cosine("1.0")),
    "weighted_contrast_angle": angle(cosine("w")),
    "euclidean_distance": guarded("0", "1 - sqrt(2)", "mu", "1 - sqrt(sum((pu-mu)*(pu-mu)))"),
    "weighted_euclidean": guarded("0", "1 - sqrt(2)", "mu", "1 - sqrt(sum((pw-mw)*(pw-mw)))"),
    "bray_curtis": guarded("0", "0", "mu", "1 - sum(abs(mu-pu))/sum(mu+pu)"),
    "weighted_bray_curtis": guarded("0", "0", "mu", "1 - sum(w*abs(mu-pu))/sum(w*(mu+pu))"),
    "pearson_corr": guarded("-1", "-1", "m", "corr(p, m)"),
    "spearman_corr": guarded("-1", "-1", "m", "corr(pr, mr)"),
    "weighted_pearson": guarded("0", "-1", "m", "corr(w*p, w*m)"),
    "dot_product": guarded("0", "0", "m", "sum(pu*mu)"),
    "weighted_dot_product": guarded("0", "0", "m", "sum(w*p*w*m)/(max(w*p)*max(w*m))"),
    "spectral_entropy": ent("p1"),
    "unweighted_spectral_entropy": UNWEIGHTED,
    "weighted_spectral_entropy": f"{UNWEIGHTED}*sqrt({ent('p1')})",
    "heuristic_spectral_entropy": entropy_score("ph", "mh"),
}


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.top_fragments(adapters.frags(spark, sf_dir), 20)


def matched(spark: SparkSession, sf_dir: str, fragments: DataFrame | None = None) -> DataFrame:
    """The match table: p, m and the bin weight w of every kept fragment."""
    fragments = kept(spark, sf_dir) if fragments is None else fragments
    found = match.peak_match(fragments, adapters.peaks(spark, sf_dir))
    found = found.withColumnsRenamed({"intensity": "p", "matched": "m"})
    bins = spark.range(70).select(F.col("id").alias("bin"), ((F.col("id") * 7 % 10 + 1) / 10).alias("weight"))
    return similarity.bin_weights(found, bins, 10.0)


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def _score(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = similarity.similarity(matched(spark, sf_dir), [name])
        return found.select("psm", F.round(name, 6).alias(name))

    return run


for _name, _sql in SCORES.items():
    register(_name, with_views(f"select psm, round({_sql}, 6) as {_name} from all_columns group by psm", *CHAIN))(_score(_name))


@register("sum1_normalize", with_views("select psm, pos, round(p1, 6) as p1, round(m1, 6) as m1 from norm", *CHAIN[:5]))
def sum1_normalize(spark, sf_dir):
    return similarity.normalized(matched(spark, sf_dir)).select("psm", "pos", F.round("p1", 6).alias("p1"), F.round("m1", 6).alias("m1"))


@register("unit_normalize", with_views("select psm, pos, round(pu, 6) as pu, round(mu, 6) as mu from norm", *CHAIN[:5]))
def unit_normalize(spark, sf_dir):
    return similarity.normalized(matched(spark, sf_dir)).select("psm", "pos", F.round("pu", 6).alias("pu"), F.round("mu", 6).alias("mu"))


@register("bin_weights", with_views("select psm, pos, w from wm", *CHAIN[:4]))
def bin_weights(spark, sf_dir):
    return matched(spark, sf_dir).select("psm", "pos", "w")


@register("peak_match", with_views("select psm, pos, round(m, 6) as matched from theory", FRAGS, ALL_MATCHED))
def peak_match(spark, sf_dir):
    found = match.peak_match(adapters.frags(spark, sf_dir), adapters.peaks(spark, sf_dir))
    return found.select("psm", "pos", F.round("matched", 6).alias("matched"))


@register(
    "peak_match_da",
    with_views(
        "select k.psm, k.pos, round(coalesce(max(p.intensity), 0), 6) as matched from frags k left join peaks p on p.scan = k.scan and p.mz between k.mz - 10.5::double and k.mz + 10.5::double group by k.psm, k.pos",
        FRAGS,
    ),
)
def peak_match_da(spark, sf_dir):
    found = match.peak_match(adapters.frags(spark, sf_dir), adapters.peaks(spark, sf_dir), tolerance=10.5, unit="da", width=25.0)
    return found.select("psm", "pos", F.round("matched", 6).alias("matched"))


@register("peak_match_arrays", ORACLES["peak_match"])
def peak_match_arrays(spark, sf_dir):
    f = adapters.frags(spark, sf_dir).groupBy("psm", "scan").agg(F.array_sort(F.collect_list(F.struct("mz", "pos"))).alias("fragments"))
    p = adapters.peaks(spark, sf_dir).groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    rows = match.peak_match_arrays(f.join(p, "scan", "left").withColumn("peaks", F.coalesce("peaks", F.array())))
    return rows.select("psm", F.explode(F.arrays_zip("fragments", "matched")).alias("f")).select("psm", "f.fragments.pos", F.round("f.matched", 6).alias("matched"))


@register(
    "tolerance_mode",
    with_views("select psm, pos, case when psm % 7 = 0 then 'da' when ion_type in ('b') then 'ppm' else 'da' end as unit from frags", FRAGS),
)
def tolerance_mode(spark, sf_dir):
    unit = match.tolerance_mode(F.col("psm") % 7 == 0, F.col("ion_type"), ["b"], "ppm", "da")
    return adapters.frags(spark, sf_dir).select("psm", "pos", unit.alias("unit"))


@register("max_normalize", with_views("select psm, pos, round(intensity/max(intensity) over (partition by psm), 6) as intensity from frags", FRAGS))
def max_normalize(spark, sf_dir):
    return library.max_normalize(adapters.frags(spark, sf_dir)).select("psm", "pos", F.round("intensity", 6).alias("intensity"))


@register("base_peak_filter", with_views("select psm, pos, round(intensity, 6) as intensity from frags qualify intensity >= max(intensity) over (partition by psm)*0.1::double", FRAGS))
def base_peak_filter(spark, sf_dir):
    return library.base_peak_filter(adapters.frags(spark, sf_dir), 10.0).select("psm", "pos", F.round("intensity", 6).alias("intensity"))


@register("top_fragments", with_views("select psm, pos, round(mz, 6) as mz from kept", FRAGS, KEPT))
def top_fragments(spark, sf_dir):
    return kept(spark, sf_dir).select("psm", "pos", F.round("mz", 6).alias("mz"))


@register("ion_type_filter", with_views("select psm, pos, ion_type from frags where ion_type in ('b', 'y', 'a') and ion_type not in ('y')", FRAGS))
def ion_type_filter(spark, sf_dir):
    return library.ion_type_filter(adapters.frags(spark, sf_dir), ["b", "y", "a"], ("y",)).select("psm", "pos", "ion_type")


@register(
    "ms2_window_filter",
    with_views(
        """select psm, case when n > 1 then n else 0 end as n, round(case when n > 1 then low else null end, 6) as lowest from (
select psm, count(*) filter (mz between 200 + psm % 400 and 500) as n, min(mz) filter (mz between 200 + psm % 400 and 500) as low from frags group by psm)""",
        FRAGS,
    ),
)
def ms2_window_filter(spark, sf_dir):
    rows = adapters.frags(spark, sf_dir).groupBy("psm").agg(F.array_sort(F.collect_list(F.struct("mz", "pos"))).alias("f"))
    kept_in = library.ms2_window(F.col("f"), 200 + F.col("psm") % 400, F.lit(500.0))
    return rows.select("psm", kept_in.alias("f")).select("psm", F.size("f").cast("long").alias("n"), F.round(F.array_min(F.transform("f", lambda s: s["mz"])), 6).alias("lowest"))


@register(
    "merge_close_mz",
    with_views(
        """, placed as (select psm, mz, intensity, ion_type, case when ion_type = 'y' then 1 else 2 end as pri, row_number() over (partition by psm order by mz, pos) as i from kept),
walk as (select psm, i, mz, intensity, ion_type, pri, 1::bigint as n, false as joined from placed where i = 1
  union all select p.psm, p.i, case when p.mz - w.mz < 25 then (w.mz + p.mz)/2 else p.mz end, case when p.mz - w.mz < 25 then w.intensity + p.intensity else p.intensity end,
    case when p.mz - w.mz < 25 and w.pri <= p.pri then w.ion_type else p.ion_type end, case when p.mz - w.mz < 25 then least(w.pri, p.pri) else p.pri end,
    case when p.mz - w.mz < 25 then w.n + 1 else 1 end, p.mz - w.mz < 25 from walk w join placed p on p.psm = w.psm and p.i = w.i + 1)
select psm, mz, round(intensity, 6) as intensity, ion_type, n from (select *, lead(joined) over (partition by psm order by i) as goes_on from walk) where goes_on is not true""",
        FRAGS,
        KEPT,
    ).replace("with ", "with recursive ", 1),
)
def merge_close_mz(spark, sf_dir):
    rows = kept(spark, sf_dir).withColumn("priority", F.when(F.col("ion_type") == "y", 1).otherwise(2))
    return library.merge_close(rows, 25.0).select("psm", "mz", F.round("intensity", 6).alias("intensity"), "ion_type", "n")


# Fragments of six types by their place; x is in no hierarchy here and so in no group.

GROUP_IONS, GROUP_AUX = ["y", "b", "a", "c", "unknown"], ("a", "c")
MODES = {
    "all": {"a_b_c_unknown_y": "y b a c unknown"}, "aux": {"b_unknown_y": "y b unknown", "a_c": "a c"}, "yb": {"b_y": "y b", "a_c_unknown": "a c unknown"},
    "yb_unknown": {"b_y": "y b", "a_c": "a c", "unknown": "unknown"}, "each": {i: i for i in GROUP_IONS}, "electron": {"c_y_z_zdot": "c y z zdot", "unknown": "unknown"},
}
TYPED = f"""typed as (select * exclude (ion_type), ['y', 'b', 'a', 'c', 'unknown', 'x'][pos % 6 + 1] as ion from matched),
groups as (select * from (values {', '.join(f"('{m}', '{g}', '{i}')" for m, groups in MODES.items() for g, members in groups.items() for i in members.split())}) t(mode, grp, ion)),
scored as (select psm, mode, grp, {cosine("1.0")} as cosine_similarity from typed join groups using (ion) group by psm, mode, grp)"""


def typed(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, [*GROUP_IONS, "x"]))
    return matched(spark, sf_dir).withColumn("ion_type", F.element_at(names, (F.col("pos") % 6 + 1).cast("int")))


@register("fragment_groups", with_views("select psm, mode, grp, round(cosine_similarity, 6) as cosine_similarity from scored", *CHAIN[:3], TYPED))
def fragment_groups(spark, sf_dir):
    groups = similarity.group_table(spark, list(MODES), GROUP_IONS, GROUP_AUX)
    return similarity.grouped_similarity(typed(spark, sf_dir), ["cosine_similarity"], groups).withColumn("cosine_similarity", F.round("cosine_similarity", 6))


_WIDE = ", ".join(f"""round(coalesce(max(case when grp = '{g}' then cosine_similarity end), 0), 6) as "cosine_similarity^{g}\"""" for g in MODES["yb_unknown"])


@register("fragment_group_columns", with_views(f"select psm, {_WIDE} from scored where mode = 'yb_unknown' group by psm", *CHAIN[:3], TYPED))
def fragment_group_columns(spark, sf_dir):
    return similarity.group_columns(typed(spark, sf_dir), ["cosine_similarity"], "yb_unknown", GROUP_IONS, GROUP_AUX, digits=6)


# Each match has a peptide of its own. Its theoretical ions are the ladder of that peptide; two thirds of them are observed,
# moved by up to 30 ppm, and some of them predicted, of every fifth match only b ions. Windows of the scans end at 650.

_LETTERS = "ACDEFGHIKLMNPQRSTVWY"
THEORY = f"""mass_of as (select * from (values {', '.join(f"('{k}', {v}::double)" for k, v in RESIDUES.items())}) t(aa, dm)),
residues as (select psm, i, count(*) over (partition by psm) as n, sum(dm) over (partition by psm order by i) as pre, sum(dm) over (partition by psm) as whole from (
  select psm, generate_subscripts(string_split(peptide, ''), 1) as i, unnest(string_split(peptide, '')) as aa from (select vec_id as psm, substr(repeat('{_LETTERS}', 3), 1 + vec_id % 20, 7 + vec_id % 10) as peptide from embeddings)) join mass_of using (aa)),
ladder as (select psm, number, ion as ion_type, z as charge, 4*number + (case when ion = 'y' then 2 else 0 end) + z - 1 as pos, (part + (case when ion = 'y' then {WATER!r}::double else 0 end) + z*{PROTON!r}::double)/z as mz from (
  select psm, i as number, 'b' as ion, pre as part from residues where i < n union all select psm, n - i, 'y', whole - pre from residues where i < n), range(1, 3) c(z)),
placed as (select l.*, abs(cast(embedding[number + 1] as double))*1000 as seen, abs(cast(embedding[64 - number] as double))*1000 + charge as told from ladder l join embeddings on vec_id = psm),
observed as (select psm as scan, mz*(1 + ((number + psm) % 5 - 2)*0.000015::double) as mz, seen as intensity from placed where (number + psm) % 3 <> 0),
told as (select psm, psm as scan, pos, mz, ion_type, told as p from placed where (7*number + psm) % 4 <> 0 and (psm % 5 <> 0 or ion_type = 'b') qualify row_number() over (partition by psm order by told desc, mz, pos) <= 20),
possible as (select psm, psm as scan, pos, mz, ion_type from placed semi join (select distinct psm, ion_type from told) using (psm, ion_type) where mz between 100 + psm % 40 and 650 qualify row_number() over (partition by psm, mz order by pos) = 1),
theory as (select k.psm, k.pos, coalesce(max(p.intensity), 0) as m from possible k left join observed p on {WINDOW} group by all),
drawn as (select k.psm, k.pos, coalesce(max(p.intensity), 0) as m from told k left join observed p on {WINDOW} group by all)"""


def own_ladders(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Theoretical ions of each match (with their matched intensity), its predicted fragments (likewise), and the observed peaks."""
    rows = adapters.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "psm")
    peptide = F.substring(F.repeat(F.lit(_LETTERS), 3), (1 + F.col("psm") % 20).cast("int"), (7 + F.col("psm") % 10).cast("int"))
    placed = ions.ladder(rows.withColumn("residues", ions.masses(peptide)), ["b", "y"], [1, 2], key="psm", keep=("embedding",)).withColumnRenamed("ion", "ion_type")
    pos = 4 * F.col("number") + F.when(F.col("ion_type") == "y", 2).otherwise(0) + F.col("charge") - 1
    value = lambda at: F.abs(F.element_at("embedding", at.cast("int")).cast("double")) * 1000
    placed = placed.withColumns({"scan": F.col("psm"), "pos": pos.cast("long"), "seen": value(F.col("number") + 1), "intensity": value(64 - F.col("number")) + F.col("charge")}).drop("embedding")
    moved = F.col("mz") * (1 + ((F.col("number") + F.col("psm")) % 5 - 2) * F.lit(0.000015))
    observed = placed.filter((F.col("number") + F.col("psm")) % 3 != 0).select("scan", moved.alias("mz"), F.col("seen").alias("intensity"))
    told = library.top_fragments(placed.filter(((7 * F.col("number") + F.col("psm")) % 4 != 0) & ((F.col("psm") % 5 != 0) | (F.col("ion_type") == "b"))), 20)
    scans = rows.select(F.col("psm").alias("scan"), (100 + F.col("psm") % 40).alias("ms2_lo"), F.lit(650).alias("ms2_hi"))
    possible = similarity.theoretical_ions(placed, told, scans)
    met = lambda some: match.peak_match(some.select("psm", "scan", "pos", "mz", "ion_type"), observed).withColumnRenamed("matched", "m")
    return met(possible), met(told), observed


COUNTS = """counts as (select psm, population, matched, least(draws, population) as draws, least(k, matched) as k from (
  select psm, count(*) as population, count(*) filter (m > 0) as matched from theory group by psm) join (
  select psm, count(*) as draws, count(*) filter (m > 0) as k from drawn group by psm) using (psm))"""


@register(
    "hypergeometric_probability",
    with_views(
        """, terms as (select psm, sum(exp(lgamma(matched+1) - lgamma(x+1) - lgamma(matched-x+1) + lgamma(population-matched+1) - lgamma(draws-x+1) - lgamma(population-matched-draws+x+1)
    - lgamma(population+1) + lgamma(draws+1) + lgamma(population-draws+1))) as tail
  from (select *, unnest(range(greatest(k, draws - (population - matched)), least(matched, draws) + 1)) as x from counts) group by psm)
select psm, round(case when draws <= 1 then 0 else 0 - log10(least(coalesce(tail, 0), 1)) end, 6) as hypergeometric_probability from counts left join terms using (psm)""",
        THEORY,
        COUNTS,
    ),
)
def hypergeometric_probability(spark, sf_dir):
    theory, told, _ = own_ladders(spark, sf_dir)
    possible = theory.groupBy("psm").agg(F.count("*").alias("population"), F.count_if(F.col("m") > 0).alias("matched"))
    drawn = told.groupBy("psm").agg(F.count("*").alias("draws"), F.count_if(F.col("m") > 0).alias("k"))
    found = similarity.hypergeometric(possible.join(drawn, "psm"))
    return found.select("psm", F.round("hypergeometric_probability", 6).alias("hypergeometric_probability"))


@register(
    "intersection",
    with_views(
        """select psm, count(*) filter (r <= 20 and r < n and m > 0 and exists (select 1 from drawn x where x.psm = t.psm and x.m = t.m)) as intersection from (
select *, row_number() over (partition by psm order by m desc, pos) as r, count(*) over (partition by psm) as n from theory) t group by psm""",
        THEORY,
    ),
)
def intersection(spark, sf_dir):
    theory, told, _ = own_ladders(spark, sf_dir)
    return similarity.intersection(theory.select("psm", "pos", F.col("m").alias("intensity")), told)


@register(
    "top6_matched_intensity",
    with_views(
        """select psm, round(case when n >= 2 and den > 0 then num/den else 0 end, 6) as top6_matched_intensity from (
select psm, any_value(scan) as scan, any_value(n) as n, sum(ln(m + 1)) as num from (select *, row_number() over (partition by psm order by p desc, pos) as r, count(*) over (partition by psm) as n from matched) where r <= 6 group by psm)
left join (select scan, sum(case when intensity > mean then ln(intensity + 1) else 0 end) as den from (select *, avg(intensity) over (partition by scan) as mean from peaks) group by scan) using (scan)""",
        *CHAIN[:3],
    ),
)
def top6_matched_intensity(spark, sf_dir):
    found = similarity.top6(matched(spark, sf_dir), adapters.peaks(spark, sf_dir))
    return found.select("psm", F.round("top6_matched_intensity", 6).alias("top6_matched_intensity"))


_BOOT = """boot as (select psm, r, p, m from (select *, unnest(range(1, 501)) as r, count(*) over (partition by psm) as n from matched)
  qualify row_number() over (partition by psm, r order by md5(psm || '|' || pos || '|' || r), pos) <= ceil(n*0.5::double)),
shares as (select psm, r, case when count(*) over w = 1 then 1 when sum(p) over w > 0 then p/sum(p) over w else 0 end as p1, case when count(*) over w = 1 then 1 when sum(m) over w > 0 then m/sum(m) over w else 0 end as m1
  from boot window w as (partition by psm, r))"""


@register(
    "bootstrap_similarity",
    with_views(f"select psm, round(quantile_cont(s, 0.5), 6) as bootstrap_similarity from (select psm, r, {entropy_score('p1', 'm1')} as s from shares group by psm, r) group by psm", *CHAIN[:3], _BOOT),
)
def bootstrap_similarity(spark, sf_dir):
    found = similarity.bootstrap(matched(spark, sf_dir))
    return found.select("psm", F.round("bootstrap_similarity", 6).alias("bootstrap_similarity"))


@register(
    "longest_match_run",
    with_views(
        """select psm, coalesce(max(case when hit then n end), 0) as longest_match_run from (select psm, hit, island, count(*) as n from (
select *, row_number() over (partition by psm order by pos) - row_number() over (partition by psm, hit order by pos) as island from (select psm, pos, m > 0 as hit from theory)) group by psm, hit, island) group by psm""",
        FRAGS,
        ALL_MATCHED,
    ),
)
def longest_match_run(spark, sf_dir):
    return similarity.longest_run(matched(spark, sf_dir, adapters.frags(spark, sf_dir)))


# Shares of intensity by ion type: observed peaks above 1 % of the base peak, annotated by the fragments that explain them.

IONS = ["a", "b", "x", "y"]
ION4 = "frag4 as (select psm, scan, pos, mz, intensity, ['a','b','x','y'][pos % 4 + 1] as ion_type from frags)"
ANNOTATED = """annotated as (select p.scan as psm, p.pos, p.intensity, coalesce(min(f.ion_type), 'unknown') as ion_type
from (select * from peaks qualify intensity > 0.01*max(intensity) over (partition by scan)) p
left join frag4 f on f.scan = p.scan and p.mz between f.mz*(1 - 20.0::double*1e-6::double) and f.mz*(1 + 20.0::double*1e-6::double) group by all)"""


def fragments4(spark, sf_dir) -> DataFrame:
    return adapters.frags(spark, sf_dir).withColumn("ion_type", F.element_at(F.array(*map(F.lit, IONS)), (F.col("pos") % 4 + 1).cast("int")))


def annotated(spark, sf_dir) -> DataFrame:
    """Observed peaks with the ion type that explains them, else unknown."""
    from pyspark.sql import Window

    high = adapters.peaks(spark, sf_dir).withColumn("top", F.max("intensity").over(Window.partitionBy("scan"))).filter(F.col("intensity") > 0.01 * F.col("top")).drop("top")
    low, up = match.bounds(F.col("mz"), 20.0)
    hit = match.range_join(fragments4(spark, sf_dir), high, ["scan"], low, up, "mz").filter("peak_pos is not null").groupBy("scan", "peak_pos").agg(F.min("ion_type").alias("ion_type"))
    found = high.join(hit.withColumnRenamed("peak_pos", "pos"), ["scan", "pos"], "left")
    return found.select(F.col("scan").alias("psm"), "pos", "intensity", F.coalesce("ion_type", F.lit("unknown")).alias("ion_type"))


def _shares(view: str, value: str, prefix: str) -> str:
    return f"select psm, {', '.join(f"case when sum({value}) > 0 then sum(case when ion_type = '{i}' then {value} else 0 end)/sum({value}) else 0 end as {prefix}{i}" for i in [*IONS, 'unknown'])} from {view} group by psm"


def _rounded(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.select("psm", *(F.round(c, 6).alias(prefix + c) for c in df.columns if c != "psm"))


def _round_sql(inner: str, names: list[str]) -> str:
    return f"select psm, {', '.join(f'round({n}, 6) as {n}' for n in names)} from ({inner})"


ALL_IONS = [*IONS, "unknown"]


@register("matched_intensity_by_ion", with_views(_round_sql(_shares("annotated", "intensity", ""), ALL_IONS), FRAGS, ION4, ANNOTATED))
def matched_intensity_by_ion(spark, sf_dir):
    return _rounded(similarity.ion_shares(annotated(spark, sf_dir), "intensity", ALL_IONS))


@register("pred_intensity_by_ion", with_views(_round_sql(_shares("frag4", "intensity", ""), ALL_IONS), FRAGS, ION4))
def pred_intensity_by_ion(spark, sf_dir):
    return _rounded(similarity.ion_shares(fragments4(spark, sf_dir), "intensity", ALL_IONS))


@register("peak_counts_by_ion", with_views(_round_sql(_shares("(select *, 1.0 as one from annotated)", "one", ""), ALL_IONS), FRAGS, ION4, ANNOTATED))
def peak_counts_by_ion(spark, sf_dir):
    return _rounded(similarity.ion_shares(annotated(spark, sf_dir).withColumn("one", F.lit(1.0)), "one", ALL_IONS))


BOTH = f"select * from ({_shares('annotated', 'intensity', 'o_')}) join ({_shares('frag4', 'intensity', 'f_')}) using (psm)"


def _both(spark, sf_dir) -> DataFrame:
    seen = similarity.ion_shares(annotated(spark, sf_dir), "intensity", ALL_IONS)
    told = similarity.ion_shares(fragments4(spark, sf_dir), "intensity", ALL_IONS)
    return seen.select("psm", *(F.col(i).alias(f"o_{i}") for i in ALL_IONS)).join(told.select("psm", *(F.col(i).alias(f"f_{i}") for i in ALL_IONS)), "psm")


@register("intensities_difference_by_ion", with_views(f"select psm, {', '.join(f'round(abs(o_{i} - f_{i}), 6) as {i}' for i in ALL_IONS)} from ({BOTH})", FRAGS, ION4, ANNOTATED))
def intensities_difference_by_ion(spark, sf_dir):
    return _both(spark, sf_dir).select("psm", *(F.round(F.abs(F.col(f"o_{i}") - F.col(f"f_{i}")), 6).alias(i) for i in ALL_IONS))


@register(
    "similarity_by_ion",
    with_views(
        f"select psm, ion_type, round({UNWEIGHTED}, 6) as similarity from (select *, case when count(*) over s = 1 then 1 when sum(p) over s > 0 then p/sum(p) over s else 0 end as p1, case when count(*) over s = 1 then 1 when sum(m) over s > 0 then m/sum(m) over s else 0 end as m1 from matched window s as (partition by psm, ion_type)) group by psm, ion_type",
        *CHAIN[:3],
    ),
)
def similarity_by_ion(spark, sf_dir):
    found = similarity.similarity(matched(spark, sf_dir), ["unweighted_spectral_entropy"], ("psm", "ion_type"))
    return found.select("psm", "ion_type", F.round("unweighted_spectral_entropy", 6).alias("similarity"))


@register(
    "intensity_distribution_similarity",
    with_views(f"select psm, round(coalesce(corr(o, f), -1), 6) as similarity from ({' union all '.join(f'select psm, o_{i} as o, f_{i} as f from ({BOTH})' for i in IONS)}) group by psm", FRAGS, ION4, ANNOTATED),
)
def intensity_distribution_similarity(spark, sf_dir):
    long = _both(spark, sf_dir).select("psm", F.explode(F.array(*(F.struct(F.col(f"o_{i}").alias("o"), F.col(f"f_{i}").alias("f")) for i in IONS))).alias("s"))
    return long.groupBy("psm").agg(F.round(F.coalesce(similarity.correlation(F.col("s.o"), F.col("s.f")), F.lit(-1.0)), 6).alias("similarity"))
