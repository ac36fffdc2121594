"""Predicted-library preprocessing and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions import ions


def max_normalize(fragments: DataFrame, by: str = "psm") -> DataFrame:
    """intensity divided by the largest one of the precursor."""
    return fragments.withColumn("intensity", F.col("intensity") / F.max("intensity").over(Window.partitionBy(by)))


def base_peak_filter(fragments: DataFrame, percent: float, by: str = "psm") -> DataFrame:
    """Fragments of at least ``percent`` of the precursor's base peak."""
    top = F.max("intensity").over(Window.partitionBy(by))
    return fragments.withColumn("__top", top).filter(F.col("intensity") >= F.col("__top") * F.lit(percent / 100)).drop("__top")


def top_fragments(fragments: DataFrame, n: int = 20, by: str = "psm") -> DataFrame:
    """The n most intense fragments, ties to the lowest m/z; Spark cuts each group before it is shuffled."""
    order = Window.partitionBy(by).orderBy(F.desc("intensity"), F.asc("mz"), F.asc("pos"))
    return fragments.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).drop("__rank")


def ion_type_filter(fragments: DataFrame, allow: list[str] | None = None, deny: tuple[str, ...] = ()) -> DataFrame:
    kept = fragments if allow is None else fragments.filter(F.col("ion_type").isin(allow))
    return kept.filter(~F.col("ion_type").isin(list(deny))) if deny else kept


def ms2_window(fragments: Column, low: Column, high: Column) -> Column:
    """Fragments inside the scan's window, ends included; an empty array unless two or more are left."""
    inside = F.filter(fragments, lambda f: f["mz"].between(low, high))
    return F.when(F.size(inside) > 1, inside).otherwise(F.slice(inside, F.lit(1), F.lit(0)))


def merge_close(fragments: DataFrame, gap: float = 1e-5, by: str = "psm") -> DataFrame:
    """Neighbours closer than ``gap`` become one, from the lowest m/z up: the mean of the two, which the next fragment is then compared with, their summed intensity, and the type of the better-ranked (of equal rank, the earlier) one.

    fragments: by, pos, mz, intensity, ion_type, priority (smaller is better, null is worst; of two nulls the later
    stays). The fold goes over one sorted array for each precursor, whose fragments are few.
    """
    held = F.struct("mz", "pos", "intensity", "ion_type", "priority")
    rows = fragments.groupBy(by).agg(F.array_sort(F.collect_list(held)).alias("f"))
    state = "struct<mz:double,intensity:double,ion_type:string,priority:int,n:long>"
    one = lambda f: F.struct(f["mz"].alias("mz"), f["intensity"].alias("intensity"), f["ion_type"].alias("ion_type"), f["priority"].cast("int").alias("priority"), F.lit(1).cast("long").alias("n")).cast(state)

    def joined(last: Column, f: Column) -> Column:
        stays = last["priority"].isNotNull() & (f["priority"].isNull() | (last["priority"] <= f["priority"]))
        return F.struct(
            ((last["mz"] + f["mz"]) / 2).alias("mz"), (last["intensity"] + f["intensity"]).alias("intensity"), F.when(stays, last["ion_type"]).otherwise(f["ion_type"]).alias("ion_type"),
            F.when(stays, last["priority"]).otherwise(f["priority"].cast("int")).alias("priority"), (last["n"] + 1).alias("n"),
        ).cast(state)

    def step(done: Column, f: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = F.coalesce(f["mz"] - last["mz"] < gap, F.lit(False))
        return F.when(near, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined(last, f)))).otherwise(F.concat(done, F.array(one(f))))

    folded = F.aggregate("f", F.array().cast(f"array<{state}>"), step)
    return rows.select(by, F.explode(folded).alias("f")).select(by, "f.mz", "f.intensity", "f.ion_type", "f.n")


def merge_libraries(first: DataFrame, later: DataFrame, properties: list[str], key: str = "precursor") -> DataFrame:
    """Libraries in load order: a key of the first keeps its row but for ``properties`` of the later; a key only in the later keeps the whole later row."""
    a, b = first.alias("a"), later.alias("b")
    cols = []
    for c in first.columns:
        if c == key:
            cols.append(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c))
        elif c in properties:
            cols.append(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c))
        else:
            cols.append(F.when(F.col(f"a.{key}").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*cols)


def merge_aux(primary: Column, aux: Column) -> tuple[Column, Column]:
    """Primary and auxiliary fragments in m/z order, and whether the match is made in Da: a primary of at most one fragment gives way to the auxiliary ones."""
    poor = F.size(primary) <= 1
    return F.when(poor, F.array_sort(aux)).otherwise(F.array_sort(F.concat(primary, aux))), poor


def attach(psms: DataFrame, library: DataFrame, key: str = "precursor") -> DataFrame:
    """PSMs with their predictions; a miss has ``missing`` true and zero predictions."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c, t in library.dtypes if c != key and t == "double"}
    return psms.join(library.withColumn("__hit", F.lit(True)), key, "left").withColumns(zero | {"missing": F.col("__hit").isNull()}).drop("__hit")


def transfer(wanted: DataFrame, predictions: DataFrame, *, key: str = "precursor", alternative: str = "translated", new: str = "masses", old: str = "translated_masses", eligible: str = "eligible", strict: bool = False) -> DataFrame:
    """Each wanted precursor with the prediction of its own key, else that of its translated key; ``source`` tells which.

    wanted: key, alternative, ``new`` and ``old`` (modification masses of both, see ions.mod_shift) and ``eligible``
    (whether the model takes the peptide). A prediction of the translated key (source translated) keeps its values, and
    its ``fragments`` (mz, ion_type, frag_num, charge and more), if it has some, are moved by the difference of the masses.
    Without any prediction a peptide that the model does not take (skipped) has no fragments and zeros; one that it takes
    (missing) is an error: ``missing`` lists them, and ``strict`` raises at the first one.
    """
    values = [c for c in predictions.columns if c != key]
    own = predictions.withColumn("__own", F.lit(True))
    other = predictions.select(F.col(key).alias(alternative), *(F.col(c).alias(f"__{c}") for c in values), F.lit(True).alias("__other"))
    joined = wanted.join(own, key, "left").join(other, alternative, "left")
    source = F.when(F.col("__own"), "exact").when(F.col("__other"), "translated").when(F.coalesce(eligible, F.lit(False)), "missing").otherwise("skipped")
    if strict:
        source = F.when(source == "missing", F.raise_error(F.concat(F.lit("no prediction of "), key, F.lit(" or "), F.coalesce(alternative, F.lit("none"))))).otherwise(source)

    def value(c: str) -> Column:
        theirs, kind = F.col(f"__{c}"), predictions.schema[c].dataType
        none = F.array().cast(kind) if c == "fragments" else F.lit(0).cast(kind)
        if c == "fragments":
            shift = lambda f: ions.mod_shift(F.col(old), F.col(new), f["ion_type"], f["frag_num"], f["charge"])
            theirs = F.transform(theirs, lambda f: f.withField("mz", f["mz"] + shift(f)))
        return F.when(F.col("__own"), F.col(c)).when(F.col("__other"), theirs).when(F.col("source") == "skipped", none)

    found = joined.withColumn("source", source)
    return found.select(*wanted.columns, *(value(c).alias(c) for c in values), "source")


def missing(transferred: DataFrame) -> DataFrame:
    """The precursors that should have a prediction and have none."""
    return transferred.filter("source = 'missing'")
