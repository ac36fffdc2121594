"""Peptide strings as Spark columns: keys, modifications, model formats, headers, filter strings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTON = 1.007276466


def base_key(peptide: Column, spec_id: Column) -> Column:
    """``base|charge``: flanking residues, trailing digits, zero masses and the terminus letters removed; the charge is the last dot-part of the id up to its underscore."""
    core = F.regexp_replace(peptide, r"^.\.|\..$", "")
    core = F.regexp_replace(F.regexp_replace(core, r"\d+$", ""), r"\[0\.0000\]", "")
    core = F.regexp_replace(F.regexp_replace(core, "^n", ""), "c", "")
    charge = F.substring_index(F.substring_index(spec_id, ".", -1), "_", 1)
    return F.concat_ws("|", core, charge)


def strip_mods(base: Column) -> Column:
    return F.regexp_replace(base, r"\[[^\]]*\]", "")


def delta_masses(base: Column) -> Column:
    """Numbers in brackets; other texts and a bracket that is never closed are left out."""
    found = F.regexp_extract_all(base, F.lit(r"\[([^\]]*)\]"), 1)
    numbers = F.filter(found, lambda x: x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))
    return F.transform(numbers, lambda x: x.cast("double"))


def _tokens(text: Column) -> Column:
    """Letters and bracketed parts, in order."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z]|\[[^\]]*\])"), 1)


def _bracket(token: Column) -> Column:
    return token.startswith("[")


def _letters_before(tokens: Column, i: Column) -> Column:
    return F.filter(F.slice(tokens, F.lit(1), i), lambda t: ~_bracket(t))


def _inside(token: Column) -> Column:
    return F.expr("null") if token is None else F.regexp_replace(token, r"[\[\]]", "")


def mod_positions(peptides: DataFrame, base: str = "base", key: str = "id") -> DataFrame:
    """(key, position, mass, residue): 0 is the n-terminus; a bracket belongs to the letter before it."""
    rows = peptides.select(key, _tokens(F.col(base)).alias("tokens"))

    def place(token: Column, i: Column) -> Column:
        before = _letters_before(F.col("tokens"), i)
        residue = F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("["))
        return F.when(_bracket(token), F.struct(F.size(before).alias("position"), residue.alias("residue"), _inside(token).alias("text")))

    found = F.filter(F.transform("tokens", place), lambda m: m.isNotNull())
    rows = rows.select(key, F.explode(found).alias("m"))
    return rows.select(key, "m.position", "m.residue", F.col("m.text").try_cast("double").alias("mass"))


@dataclass(frozen=True)
class Target:
    """How a model writes peptides: the modifications that it takes (all of the table if None), and its signs."""

    allowed: tuple[tuple[str, int], ...] | None
    name: str = "UNIMOD"
    after_n: str = "-"  #: behind a modified n-terminus
    before_n: str = ""
    before_c: str = ""  #: before a modified c-terminus
    bare_c: bool = False  #: a C without a modification is written as carbamidomethylated
    label: int | None = None  #: the label of an unmodified n-terminus; S loses it
    hidden: tuple[int, ...] = ()  #: numbers that are left out of the text
    round_brackets: bool = False


#: Modifications and signs of each target.
TARGETS = {
    "prosit": Target((("C", 4), ("M", 35)), bare_c=True),
    "prosit_cit": Target((("N", 7), ("Q", 7), ("R", 7)), bare_c=True),
    "prosit_tmt": Target((("C", 4), ("M", 35), ("[", 737), ("K", 737)), bare_c=True, label=737),
    "unispec": Target((("[", 1), ("C", 4), ("Q", 28), ("E", 27), ("M", 35), ("S", 21), ("T", 21), ("Y", 21), ("C", 26)), after_n=""),
    "diann": Target(
        (("C", 4), ("M", 35), ("[", 1), ("S", 21), ("T", 21), ("Y", 21), ("K", 121), ("T", 121), ("C", 121), ("S", 121), ("[", 121), ("[", 737), ("K", 737), ("S", 737)), name="UniMod", after_n=""
    ),
    "ms2pip": Target((("M", 35), ("C", 4))),
    "predfull": Target((("M", 35), ("C", 4)), hidden=(4,)),
    "deeplc": Target(None, after_n=""),
    "im2deep": Target(None, after_n=""),
    "alphapept": Target(None, before_c="-"),
    "librarytsv": Target(None, name="UniMod", after_n="", before_n="_", before_c="_", round_brackets=True),
}


def _mod_map(table: Iterable[tuple[str, int, float]], allowed: tuple[tuple[str, int], ...] | None) -> Column:
    """residue -> array of (id, mass), as a literal."""
    held: dict[str, list[tuple[int, float]]] = {"": []}
    for residue, ident, mass in table:
        if allowed is None or (residue, ident) in allowed:
            held.setdefault(residue, []).append((ident, mass))
    kind = "array<struct<id:int,mass:double>>"
    value = lambda mods: F.array(*(F.struct(F.lit(i).alias("id"), F.lit(float(m)).alias("mass")) for i, m in mods)).cast(kind)
    return F.create_map(*(c for residue, mods in held.items() for c in (F.lit(residue), value(mods))))


def model_text(base: Column, target: Target, table: Iterable[tuple[str, int, float]], *, c_terminal: Column | None = None, tolerance: float = 1e-3) -> Column:
    """A peptide as the target writes it, a function of its row alone.

    Each mass becomes the number of the table entry of its residue (or ``[`` for a terminus) within ``tolerance`` that
    the target takes, the smallest of several; a mass without one is dropped. ``c_terminal`` says that a bracket at the
    end belongs to the c-terminus. table: residue, id, mass; a parameter table.
    """
    known = _mod_map(table, target.allowed)
    pieces = F.regexp_extract_all(base, F.lit(r"(^\[[^\]]*\]|[A-Za-z](?:\[[^\]]*\])?)"), 1)  # a bracket at the start, or a letter with its own
    ended = F.lit(False) if c_terminal is None else c_terminal & (F.length(base) > 0)
    tail = F.lit(-1) if c_terminal is None else F.size(pieces) - 1
    left, right = ("(", ")") if target.round_brackets else ("[", "]")
    bare_c = f"C{left}{target.name}:4{right}"

    def shown(piece: Column, i: Column) -> Column:
        first, last = _bracket(piece), ended & (i == tail)
        letter = F.when(first, F.lit("")).otherwise(F.substring(piece, 1, 1))
        residue = F.when(first | last, F.lit("[")).otherwise(letter)
        mass = F.regexp_extract(piece, r"\[([^\]]*)", 1).try_cast("double")
        near = F.filter(F.coalesce(F.try_element_at(known, residue), F.element_at(known, F.lit(""))), lambda m: F.abs(m["mass"] - mass) < tolerance)
        ident = F.array_min(F.transform(near, lambda m: m["id"]))
        text = F.concat(F.lit(f"{left}{target.name}:"), ident.cast("string"), F.lit(right))
        if target.hidden:
            text = F.when(ident.isin(*target.hidden), F.lit("")).otherwise(text)
        if target.label:
            text = F.when((ident == target.label) & (residue == "S"), F.lit("")).otherwise(text)
        text = F.when(first, F.concat(F.lit(target.before_n), text, F.lit(target.after_n))).when(last, F.concat(F.lit(target.before_c), text)).otherwise(text)
        dropped = F.when(letter == "C", F.lit(bare_c)).otherwise(letter) if target.bare_c else letter
        alone = F.when(piece == "C", F.lit(bare_c)).otherwise(piece) if target.bare_c else piece
        return F.when(F.length(piece) == 1, alone).otherwise(F.coalesce(F.concat(letter, text), dropped))

    text = F.array_join(F.transform(pieces, shown), "")
    if target.label:
        text = F.when(text.startswith(left), text).otherwise(F.concat(F.lit(f"{left}{target.name}:{target.label}{right}{target.after_n}"), text))
    return text


def to_model_peptide(peptides: DataFrame, table: Iterable[tuple[str, int, float]], target: Target | str = "prosit", *, base: str = "base", c_terminal: Column | None = None, tolerance: float = 1e-3) -> DataFrame:
    """Adds ``model_peptide``: the peptide in the target's text (see ``model_text``), without a shuffle."""
    target = TARGETS[target] if isinstance(target, str) else target
    return peptides.withColumn("model_peptide", model_text(F.col(base), target, table, c_terminal=c_terminal, tolerance=tolerance))


def from_model_peptide(peptides: DataFrame, masses: dict[int, float], *, text: str = "model_peptide") -> DataFrame:
    """Adds ``base_again``: [UNIMOD:n] as its mass with four digits, numbers with four digits, the dashes of terminal brackets removed."""
    known = F.create_map(*(c for i, m in {-1: 0.0, **masses}.items() for c in (F.lit(int(i)), F.lit(float(m)))))
    parts = _tokens(F.regexp_replace(F.regexp_replace(F.col(text), r"\]-", "]"), r"-\[", "["))

    def shown(part: Column) -> Column:
        ident = F.regexp_extract(part, r"(?i)UNIMOD:(\d+)", 1).try_cast("int")
        mass = F.coalesce(F.try_element_at(known, F.coalesce(ident, F.lit(-2))), _inside(part).try_cast("double"))
        return F.when(_bracket(part) & mass.isNotNull(), F.concat(F.lit("["), F.format_string("%.4f", mass), F.lit("]"))).otherwise(part)

    return peptides.withColumn("base_again", F.array_join(F.transform(parts, shown), ""))


#: Models whose alphabet leaves out OUBZJX, and the most residues, charge and characters that models take.
NO_ODD_LETTERS = ("prosit", "ms2pip", "deeplc", "unispec", "predfull", "im2deep")
MOST_RESIDUES = {"ms2pip": 30, "prosit": 30, "unispec": 40, "deeplc": 60, "im2deep": 60}
MOST_CHARGE = {"unispec": 5, "prosit": 6}
MOST_TEXT = {"deeplc": 60}


def eligible(stripped: Column, charge: Column, formatted: Column, model: str) -> Column:
    """Whether a model takes the peptide. A rule holds for all models whose name holds the rule's; others take everything."""
    named = lambda rules: [r for r in rules if r in model.lower()]
    ok = F.lit(True)
    if named(NO_ODD_LETTERS):
        ok &= ~stripped.rlike("[OUBZJX]")
    for value, rules in ((F.length(stripped), MOST_RESIDUES), (charge, MOST_CHARGE), (F.length(formatted), MOST_TEXT)):
        for name in named(rules):
            ok &= value <= rules[name]
    return ok


def evalue(log10_evalue: Column, hyperscore: Column) -> Column:
    return F.coalesce(F.pow(F.lit(10.0), log10_evalue), F.exp(15 - hyperscore))


def label(text: Column, protein: Column | None = None) -> Column:
    """Decoy 0, target 1: from a label of -1/1, or from a ``rev`` prefix of the protein."""
    own = F.greatest(F.lit(0), text.try_cast("int"))
    return own if protein is None else F.coalesce(own, F.when(protein.startswith("rev"), 0).otherwise(1))


def rank_or_suffix(rank: Column, spec_id: Column) -> Column:
    return F.coalesce(rank.try_cast("int"), F.substring_index(spec_id, "_", -1).try_cast("int"))


def accession(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(text, r"\|"), F.lit(2)), text)


def ccs_to_mobility(ccs: Column, mass: Column, charge: Column) -> Column:
    """Mobility of an ion in nitrogen: ccs * sqrt(mu) / z / 1059.62245, mu the reduced mass with 28."""
    m = mass + charge * PROTON
    return ccs * F.sqrt(m * 28 / (m + 28)) / charge / 1059.62245


#: Words of an instrument's model or analyzer and their class, tried in order, with their case.
INSTRUMENTS = {
    "LUMOS": ("LTQ", "Lumos", "Fusion", "Elite", "Velos", "Eclipse", "Tribrid"),
    "QE": ("QE", "Exactive", "Exploris"),
    "SCIEXTOF": ("Sciex", "TripleTOF"),
    "TIMSTOF": ("flight", "timsTOF"),
    "THERMOTOF": ("Astral",),
}
#: Instruments that these models know.
UNISPEC_INSTRUMENTS = ("LUMOS", "QE", "QEHFX", "ELITE", "VELOS", "NONE")
ALPHAPEPT_INSTRUMENTS = ("QE", "LUMOS", "TIMSTOF", "SCIEXTOF")


def instrument_class(model: Column, analyzer: Column | None = None, default: str = "QE") -> Column:
    """The class of the first list of words of which one stands in the model or the analyzer."""
    texts = [model] if analyzer is None else [model, analyzer]
    out = F.lit(default)
    for name, words in reversed(INSTRUMENTS.items()):
        held = F.lit(False)
        for text in texts:
            for word in words:
                held |= F.coalesce(text.contains(word), F.lit(False))
        out = F.when(held, name).otherwise(out)
    return out


def model_instrument(instrument: Column, model: str, charge: Column) -> Column:
    """The instrument that is told to a model: what it does not know is replaced."""
    name = model.lower()
    if "unispec" in name:
        unknown = ~F.upper(instrument).isin(*UNISPEC_INSTRUMENTS) | (instrument.isin("QE", "QEHFX") & (charge == 1))
        return F.when(unknown, "NONE").otherwise(instrument)
    if "alphapept" in name:
        return F.when((instrument == "QEHFX") | ~F.upper(instrument).isin(*ALPHAPEPT_INSTRUMENTS), "QE").otherwise(instrument)
    return instrument


def filter_string(text: Column) -> tuple[Column, Column]:
    """Fragmentation type and energy of the first ``@hcd27.00`` piece with a known type; HCD and 25 without one."""
    kinds = F.transform(F.regexp_extract_all(text, F.lit("@([a-zA-Z]+)([0-9.]+)"), 1), F.upper)
    values = F.regexp_extract_all(text, F.lit("@([a-zA-Z]+)([0-9.]+)"), 2)
    known = F.filter(F.arrays_zip(kinds.alias("kind"), values.alias("value")), lambda p: p["kind"].isin("HCD", "CID", "ETD", "ECD", "UVPD"))
    first = F.try_element_at(known, F.lit(1))
    return F.coalesce(first["kind"], F.lit("HCD")), F.coalesce(first["value"].try_cast("double"), F.lit(25.0))


#: Beginnings of headers, and patterns of identifiers and genes.
UNIPROT_STARTS, NCBI_STARTS = ("sp|", "tr|", "db|"), ("AP_", "NP_", "YP_", "XP_", "ZP", "WP_")
TAIR = r"^AT.+\s\|\sSymbols:[^\|]+\s\|\s[^\|]+\s\|.*$"
IDS = {"uniprot": r"[sp|tr]\|(.+?)\|", "ncbi": r"(\w{2}_\d{1,10}\.?(\d{1,2})?)", "ensembl": r"(ENSP\w+(?:\.\d+)?)", "cptac_ensembl": r"(ENSP\w+(?:\.\d+)?)", "nextprot": r"nxp\|(.+?)\|"}
GENES = {"uniprot": r"GN=(\S+)", "ncbi": r"GN=(.+)\s[\[|OX=|GN=|PE=|$]", "ensembl": r"(ENSG\d{1,11}\.?\d?\d?)", "cptac_ensembl": r"(ENSG\d{1,11}\.?\d?\d?)", "tair": r"\|\sSymbols:\s*(.+?)\s\|"}


def protein_header(header: Column, decoy_tag: str = "rev_") -> dict[str, Column]:
    """database, id, gene, decoy and part (up to the first blank) of a FASTA header.

    The database is told by the header's beginning, after the decoy tag, ``contam_`` and the decoy tag again. An id that
    is not found is the whole header; UniRef and TAIR headers have none. A gene that is not found is empty.
    """
    plain = F.regexp_replace(header, f"^({decoy_tag})?(contam_)?({decoy_tag})?", "")
    starts = lambda words: F.greatest(*(plain.startswith(w) for w in words))
    kind = (
        F.when(starts(UNIPROT_STARTS), "uniprot").when(starts(NCBI_STARTS), "ncbi")
        .when(plain.contains("ENSP") & plain.contains("|ENST") & plain.contains("|ENSG"), "cptac_ensembl").when(plain.startswith("ENSP"), "ensembl")
        .when(plain.startswith("UniRef"), "uniref").when(plain.startswith("AT") & plain.rlike(TAIR), "tair").when(plain.startswith("nxp") & ~plain.startswith("AT"), "nextprot").otherwise("generic")
    )

    def found(patterns: dict[str, str], kind: Column, other: Column) -> Column:
        out = other
        for name, rx in patterns.items():
            out = F.when(kind == name, F.trim(F.regexp_extract(header, rx, 1))).otherwise(out)
        return out

    third = F.trim(F.coalesce(F.try_element_at(F.split(header, r"\|"), F.lit(3)), F.lit("")))
    gene = F.when(kind == "nextprot", third).otherwise(found(GENES, kind, F.lit("")))
    ident = found(IDS, kind, F.lit(""))
    ident = F.when(kind == "generic", header).when(kind.isin("uniref", "tair"), F.lit("")).when(ident == "", header).otherwise(ident)
    return {"database": kind, "id": ident, "gene": gene, "decoy": header.startswith(decoy_tag), "part": F.substring_index(header, " ", 1)}


ANNOTATION = r"^(y|b|a|x|c|z|p|IM|IN|m)(\d*)(?::(\d+))?((?:[+-]\d*[A-Z][A-Za-z0-9]*)*)(?:\^(\d+))?(?:\+?(\d*)i)?$"


def fragment_annotation(rows: DataFrame, losses: dict[str, float], *, text: str = "annotation") -> DataFrame:
    """ion_type, number, stop (of internal ions), charge, isotope and loss mass of an annotation such as ``y7-2H2O^2+1i``.

    losses: name -> mass, a parameter table; multipliers before a loss count, as do plus signs; an unknown name weighs 0.
    """
    part = lambda g: F.regexp_extract(F.col(text), ANNOTATION, g)
    known = F.create_map(*(c for name, m in {"": 0.0, **losses}.items() for c in (F.lit(name), F.lit(float(m)))))
    pieces = F.regexp_extract_all(part(4), F.lit(r"([+-]\d*[A-Z][A-Za-z0-9]*)"), 1)

    def mass(piece: Column) -> Column:
        sign = F.when(piece.startswith("-"), -1.0).otherwise(1.0)
        count = F.coalesce(F.regexp_extract(piece, r"^[+-](\d+)", 1).try_cast("int"), F.lit(1))
        return sign * count * F.coalesce(F.try_element_at(known, F.regexp_extract(piece, r"^[+-]\d*(.*)$", 1)), F.lit(0.0))

    return rows.withColumns({
        "ion_type": part(1), "number": part(2).try_cast("int"), "stop": part(3).try_cast("int"),
        "charge": F.coalesce(part(5).try_cast("int"), F.lit(1)),
        "isotope": F.when(F.col(text).rlike(r"\+?\d*i$"), F.coalesce(part(6).try_cast("int"), F.lit(1))).otherwise(0),
        "loss": F.aggregate(F.transform(pieces, mass), F.lit(0.0), lambda a, b: a + b),
    })


def response_unpack(responses: DataFrame, *, key: str = "id", length: str = "length") -> DataFrame:
    """(key, peptide, mz, intensity) of a response whose JSON ``body`` holds flat tensors of ``length`` values per peptide."""
    body = F.from_json("body", "outputs array<struct<name:string,data:array<double>>>")
    named = responses.select(key, length, F.map_from_entries(F.transform(body["outputs"], lambda o: F.struct(o["name"], o["data"]))).alias("t"))
    places = F.sequence(F.lit(0), F.size(F.col("t")["mz"]) - 1)
    flat = named.select(key, length, F.explode(F.arrays_zip(F.col("t")["mz"].alias("mz"), F.col("t")["intensities"].alias("intensity"), places.alias("i"))).alias("v"))
    rows = flat.select(key, F.floor(F.col("v.i") / F.col(length)).cast("int").alias("peptide"), (F.col("v.i") % F.col(length)).alias("i"), "v.mz", "v.intensity")
    return rows.filter("intensity > 0 and mz > 0")


def fold(precursor_peptide: Column, charge: Column, k: int) -> Column:
    """(charge + sum of code points) mod k."""
    codes = F.transform(F.filter(F.split(precursor_peptide, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.pmod(charge + F.aggregate(codes, F.lit(0), lambda a, c: a + c), F.lit(k)).cast("int")


def fold_split(rows: DataFrame, k: int) -> DataFrame:
    """Test rows of each fold and training rows: a row of fold f is in the training set of all other folds."""
    return rows.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("part", F.when(F.col("set") == F.col("fold"), "test").otherwise("train"))


def residual_letters(text: Column) -> Column:
    """Amino-acid letters of any text, upper-cased."""
    return F.upper(F.regexp_replace(text, "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]", ""))
