"""Digestion and theoretical ions: arrays per peptide, so that no ladder needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROTON, WATER, AMMONIA, CARBONYL, ISOTOPE = 1.007276466, 18.010564684, 17.026549101, 27.994914620, 1.003354835

#: Monoisotopic residue masses.
RESIDUES = {
    "A": 71.03711, "R": 156.10111, "N": 114.04293, "D": 115.02694, "C": 103.00919, "E": 129.04259, "Q": 128.05858, "G": 57.02146, "H": 137.05891, "I": 113.08406,
    "L": 113.08406, "K": 128.09496, "M": 131.04049, "F": 147.06841, "P": 97.05276, "S": 87.03203, "T": 101.04768, "W": 186.07931, "Y": 163.06333, "V": 99.06841,
}

#: Neutral mass of an ion beyond its residues; prefix ions count from the n-terminus.
PREFIX = {"b": 0.0, "a": -CARBONYL, "c": AMMONIA, "c_dot": AMMONIA + 1.00782503207, "a_plus_1": -CARBONYL + 1.00782503207}
SUFFIX = {
    "y": WATER, "x": WATER + CARBONYL - 2 * 1.00782503207, "z": WATER - AMMONIA, "z_dot": WATER - AMMONIA + 1.00782503207,
    "z_prime": WATER - AMMONIA + 2 * 1.00782503207, "x_plus_1": WATER + CARBONYL - 1.00782503207,
}
LOSSES = {"H2O": WATER, "NH3": AMMONIA}
IMMONIUM = -26.99


def pieces(sequence: Column) -> Column:
    """Parts of a protein after each K or R that no P follows."""
    cut = F.replace(F.regexp_replace(sequence, "([KR])", "$1|"), F.lit("|P"), F.lit("P"))
    return F.filter(F.split(cut, r"\|"), lambda p: p != "")


def masses(letters: Column) -> Column:
    """array<double> of residue masses."""
    table = F.create_map(*(F.lit(x) for kv in RESIDUES.items() for x in kv))
    return F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.element_at(table, c))


def whole_mass(letters: Column) -> Column:
    """Sum of the residue masses, by how often each letter occurs."""
    total = F.lit(0.0)
    for residue, mass in RESIDUES.items():
        total += (F.length(letters) - F.length(F.replace(letters, F.lit(residue), F.lit("")))) * mass
    return total


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def digest(proteins: DataFrame, *, key: str = "protein", sequence: str = "sequence", lengths: tuple[int, int] = (7, 50), range_: tuple[float, float] = (500.0, 5000.0), decoy_tag: str | None = "rev_") -> DataFrame:
    """peptide, protein, mass: peptides inside the bounds, without B, X and Z, that belong to exactly one protein.

    Proteins whose key starts with ``decoy_tag`` are left out.
    """
    if decoy_tag:
        proteins = proteins.filter(~F.col(key).cast("string").startswith(decoy_tag))
    rows = proteins.select(key, F.explode(pieces(F.col(sequence))).alias("peptide")).filter(F.length("peptide").between(*lengths) & ~F.col("peptide").rlike("[BXZ]"))
    single = rows.groupBy("peptide").agg(F.min(key).alias(key), F.max(key).alias("__last")).filter(F.col(key) == F.col("__last")).drop("__last")
    return single.withColumn("mass", whole_mass(F.col("peptide")) + WATER).filter(F.col("mass").between(*range_))


def running(values: Column) -> Column:
    """Prefix sums."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))


def mz(mass: Column, charge: Column, isotope: Column | None = None, loss: Column | None = None) -> Column:
    m = mass if isotope is None else mass + isotope * ISOTOPE
    m = m if loss is None else m - loss
    return (m + charge * PROTON) / charge


def _lost(losses: tuple[str, ...]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(LOSSES.get(name, 0.0)).alias("mass")) for name in ("", *losses)))


def positions(peptides: DataFrame, *, key: str = "peptide", residues: str = "residues", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, number, front and back: the residue masses of the first and of the last ``number`` residues, a row for each inner position."""
    n = F.size(residues)
    rows = peptides.select(key, *keep, running(F.col(residues)).alias("sums"), n.alias("n")).filter("n > 1")
    inner = F.slice("sums", F.lit(1), F.col("n") - 1)
    rows = rows.select(key, *keep, F.element_at("sums", -1).alias("whole"), F.posexplode(F.arrays_zip(inner.alias("front"), F.reverse(inner).alias("rest"))).alias("number", "p"))
    return rows.select(key, *keep, (F.col("number") + 1).alias("number"), "p.front", (F.col("whole") - F.col("p.rest")).alias("back"))


def _kinds(ions: list[str], charges: list[int], isotopes: tuple[int, ...], losses: tuple[str, ...]) -> list[tuple[str, int, int, str]]:
    """ion, charge, isotope and loss of a ladder; a c ion loses water only."""
    return [(i, z, k, name) for i in ions for z in charges for k in isotopes for name in ("", *losses) if not (i == "c" and name == "NH3")]


def _of_kind(ion: str, charge: int, isotope: int, loss: str) -> Column:
    """m/z of an ion at a position."""
    part = F.col("front") if ion in PREFIX else F.col("back")
    return mz(part + {**PREFIX, **SUFFIX}[ion], F.lit(charge), F.lit(isotope), F.lit(LOSSES.get(loss, 0.0)))


def ladder(peptides: DataFrame, ions: list[str], charges: list[int], isotopes: tuple[int, ...] = (0,), losses: tuple[str, ...] = (), *, key: str = "peptide", residues: str = "residues", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, ion, number, charge, isotope, loss, mz) of prefix and suffix ions at every inner position.

    residues: array of residue masses with their modifications. A filter on mz or ion that follows is evaluated row by
    row in the same stage, so ions outside a window are never shuffled.
    """
    one = lambda i, z, k, name: F.struct(F.lit(i).alias("ion"), F.lit(z).alias("charge"), F.lit(k).alias("isotope"), F.lit(name).alias("loss"), _of_kind(i, z, k, name).alias("mz"))
    rows = positions(peptides, key=key, residues=residues, keep=keep).select(key, *keep, "number", F.explode(F.array(*(one(*kind) for kind in _kinds(ions, charges, isotopes, losses)))).alias("x"))
    return rows.select(key, *keep, "x.ion", "number", "x.charge", "x.isotope", "x.loss", "x.mz")


def ladder_sums(peptides: DataFrame, value, by: tuple[str, ...], ions: list[str], charges: list[int], isotopes: tuple[int, ...] = (0,), losses: tuple[str, ...] = (), *, key: str = "peptide", residues: str = "residues") -> DataFrame:
    """key, by (of ion, charge, isotope, loss), n and total: the number of a ladder's ions and the sum of value(mz) over them.

    The kinds of a group are terms of one column, so a position is one row of the aggregation whatever the number of
    kinds, and what is shuffled is one row a peptide.
    """
    at = {"ion": 0, "charge": 1, "isotope": 2, "loss": 3}
    groups: dict[tuple, list[tuple]] = {}
    for kind in _kinds(ions, charges, isotopes, losses):
        groups.setdefault(tuple(kind[at[b]] for b in by), []).append(kind)
    terms = []
    for k, kinds in enumerate(groups.values()):
        term = value(_of_kind(*kinds[0]))
        for kind in kinds[1:]:
            term = term + value(_of_kind(*kind))
        terms.append(F.sum(term).alias(f"t{k}"))
    sums = positions(peptides, key=key, residues=residues).groupBy(key).agg(F.count("*").alias("n"), *terms)
    one = lambda k, names, kinds: F.struct(*(F.lit(v).alias(b) for b, v in zip(by, names, strict=True)), (F.col("n") * len(kinds)).alias("n"), F.col(f"t{k}").alias("total"))
    return sums.select(key, F.explode(F.array(*(one(k, *group) for k, group in enumerate(groups.items())))).alias("x")).select(key, "x.*")


def internal(peptides: DataFrame, losses: tuple[str, ...] = ("H2O", "NH3"), *, key: str = "peptide", residues: str = "residues", first: int = 2) -> DataFrame:
    """(key, ion, start, stop, loss, mz): inner parts of two residues or more, from the ``first`` residue to the last but one, as b and a types of charge 1."""
    rows = peptides.select(key, running(F.col(residues)).alias("sums"), F.size(residues).alias("n")).filter(F.col("n") >= first + 2)
    rows = rows.select(key, "sums", "n", F.explode(F.sequence(F.lit(first), F.col("n") - 2)).alias("start"))
    rows = rows.select("*", F.explode(F.sequence(F.col("start") + 1, F.col("n") - 1)).alias("stop"))
    part = F.element_at("sums", F.col("stop")) - F.element_at("sums", F.col("start") - 1)
    kinds = F.array(F.struct(F.lit("b").alias("ion"), F.lit(0.0).alias("offset")), F.struct(F.lit("a").alias("ion"), F.lit(-CARBONYL).alias("offset")))
    rows = rows.select(key, "start", "stop", part.alias("part")).select("*", F.explode(kinds).alias("o")).select("*", F.explode(_lost(losses)).alias("l"))
    return rows.select(key, F.col("o.ion").alias("ion"), "start", "stop", F.col("l.name").alias("loss"), (F.col("part") + F.col("o.offset") - F.col("l.mass") + PROTON).alias("mz"))


def immonium(peptides: DataFrame, *, key: str = "peptide", letters: str = "peptide", residues: str = "residues") -> DataFrame:
    """(key, residue, mz): of each residue's first occurrence, its mass with modification less 26.99."""
    chars = F.filter(F.split(F.col(letters), ""), lambda c: c != "")
    rows = peptides.select(F.col(key), F.posexplode(F.arrays_zip(chars.alias("c"), F.col(residues).alias("m"))).alias("pos", "r"))
    return rows.groupBy(key, F.col("r.c").alias("residue")).agg((F.min_by("r.m", "pos") + IMMONIUM).alias("mz"))


def immonium_of_table(peptides: DataFrame, table: DataFrame, *, key: str = "peptide", letters: str = "peptide") -> DataFrame:
    """(key, name, mz): the immonium and related ions of the residues that occur. table: name, residue, mass; a parameter table, broadcast."""
    chars = F.array_distinct(F.filter(F.split(F.col(letters), ""), lambda c: c != ""))
    rows = peptides.select(key, F.explode(chars).alias("residue"))
    return rows.join(F.broadcast(table), "residue").select(key, "name", F.col("mass").alias("mz"))


def precursors(peptides: DataFrame, charges: list[int], isotopes: tuple[int, ...] = (0,), losses: tuple[str, ...] = (), *, key: str = "peptide", residues: str = "residues") -> DataFrame:
    rows = peptides.select(key, (total(F.col(residues)) + WATER).alias("m"), F.explode(F.array(*map(F.lit, charges))).alias("charge"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, isotopes))).alias("isotope")).select("*", F.explode(_lost(losses)).alias("l"))
    return rows.select(key, "charge", "isotope", F.col("l.name").alias("loss"), mz(F.col("m"), F.col("charge"), F.col("isotope"), F.col("l.mass")).alias("mz"))


def mod_shift(old: Column, new: Column, ion: Column, number: Column, charge: Column, start: Column | None = None, stop: Column | None = None) -> Column:
    """m/z shift of an ion when modification masses change: old and new are arrays of n + 2 masses (n-term, residues, c-term).

    Prefix ions hold positions 0..number, suffix ions the last number + 1, ions of all residues and the precursor all, internal ions start..stop; others do not move.
    """
    n = F.size(new)
    whole = number >= n - 2
    front = lambda a: total(F.when(whole, a).otherwise(F.slice(a, F.lit(1), number + 1)))
    back = lambda a: total(F.when(whole, a).otherwise(F.slice(a, F.greatest(F.lit(1), n - number), number + 1)))
    part = lambda a: F.when(ion.isin(*PREFIX), front(a)).when(ion.isin(*SUFFIX), back(a)).when(ion == "p", total(a))
    if start is not None:
        inner = lambda a: total(F.slice(a, start + 1, stop - start + 1))
        diff = F.when(ion == "int", inner(new) - inner(old)).otherwise(F.coalesce(part(new) - part(old), F.lit(0.0)))
    else:
        diff = F.coalesce(part(new) - part(old), F.lit(0.0))
    return diff / charge


def charge_fanout(predictions: DataFrame, most: int = 8) -> DataFrame:
    """A charge-free prediction as one row for each charge."""
    return predictions.withColumn("charge", F.explode(F.sequence(F.lit(1), F.lit(most))))


#: An entry of the dictionary index holds so many ions at most.
ENTRY = 256


def possible_ions(peptides: DataFrame, dictionary: DataFrame, *, activation: str = "HCD", key: str = "peptide", letters: str = "peptide", residues: str = "residues", charge: str = "charge") -> DataFrame:
    """(key, ion, number, charge, start, extent, loss, mz) of the dictionary ions that a peptide can have.

    A ladder ion (b, y, a) needs a number below the length; an inner ion (int) a start of 2 or more below the length and
    an end before the last residue; an immonium ion (imm) its residue; a charged precursor (p) electron-based
    activation, as HCD and CID take no charge off (charge 0 means the peptide's own); and a loss that ``needs`` a
    modification that mass among the peptide's ``deltas`` (within 0.0002, ends included).

    dictionary: ion, number, charge, start, extent, residue, loss, lost (its mass), needs, mass (of immonium ions). It
    is indexed by what an ion needs: its ladder number or its inner end or its residue, and its modification. A
    peptide looks its own needs up by equality, so it meets the ions that it can have and no others. Both sides are joined
    by these keys, in any size.
    """
    electron = activation not in ("HCD", "CID")
    last = F.col("start") + F.col("extent") - 1
    need = F.when(F.col("ion") == "imm", F.concat(F.lit("r"), "residue")).when(F.col("ion") == "int", F.concat(F.lit("e"), last.cast("string"))).when(F.col("ion") == "p", F.lit("p")).otherwise(F.concat(F.lit("n"), F.col("number").cast("string")))
    usable = (F.col("ion") != "p") | (F.col("charge") == 0) | F.lit(electron)
    usable &= (F.col("ion") != "int") | (F.col("start") >= 2)
    fields = ["ion", "number", "charge", "start", "extent", "loss", "lost", "mass"]
    entries = dictionary.filter(usable).withColumn("need", need).withColumn("mod", F.coalesce(F.floor(F.col("needs") * 1000), F.lit(-1)))
    entries = entries.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("need", "mod").orderBy(*fields)) - 1) / ENTRY))
    entries = entries.groupBy("need", "mod", "part").agg(F.first("needs").alias("needs"), F.collect_list(F.struct(*fields)).alias("found"))  # at most ENTRY ions each

    size = F.length(letters)
    chars = F.array_distinct(F.filter(F.split(F.col(letters), ""), lambda c: c != ""))
    inner = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    asks = F.concat(F.transform(inner, lambda i: F.concat(F.lit("n"), i.cast("string"))), F.transform(inner, lambda i: F.concat(F.lit("e"), i.cast("string"))), F.transform(chars, lambda c: F.concat(F.lit("r"), c)), F.array(F.lit("p")))
    around = F.transform("deltas", lambda d: F.array(F.floor((d - 0.0002) * 1000), F.floor((d + 0.0002) * 1000)))  # a modification mass lies in one of both
    marks = F.array_distinct(F.concat(F.array(F.lit(-1).cast("long")), F.flatten(around)))
    rows = peptides.select(key, F.col(charge).alias("__z"), "deltas", running(F.col(residues)).alias("__sums"), size.alias("__size"), asks.alias("__asks"), marks.alias("__marks"))
    rows = rows.select("*", F.explode("__marks").alias("mod")).select("*", F.explode("__asks").alias("need")).drop("__asks", "__marks")
    held = F.col("needs").isNull() | F.exists("deltas", lambda d: F.abs(d - F.col("needs")) <= 0.0002)
    met = rows.join(entries, ["need", "mod"]).filter(held).select(key, "__z", "__sums", "__size", F.explode("found").alias("d")).select(key, "__z", "__sums", "__size", "d.*")

    upto = lambda i: F.when(i < 1, 0.0).otherwise(F.get("__sums", (i - 1).cast("int")))
    whole = upto(F.col("__size"))
    z = F.when((F.col("ion") == "p") & (F.col("charge") == 0), F.col("__z")).otherwise(F.col("charge"))
    mass = F.when(F.col("ion") == "p", whole + WATER).when(F.col("ion") == "int", upto(last) - upto(F.col("start") - 1)).when(F.col("ion") == "y", whole - upto(F.col("__size") - F.col("number")) + WATER)
    mass = mass.otherwise(upto(F.col("number")) + F.when(F.col("ion") == "a", -CARBONYL).otherwise(0.0))
    value = F.when(F.col("ion") == "imm", F.col("mass")).otherwise((mass - F.col("lost") + z * PROTON) / z)
    return met.select(key, "ion", "number", z.alias("charge"), "start", "extent", "loss", value.alias("mz"))
