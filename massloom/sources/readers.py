"""Readers of search results, spectra, libraries and tables, on Spark's text, CSV, XML and Parquet sources."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pin_scan(spark: SparkSession, path: str, columns: dict[str, str], protein_column: str = "Proteins") -> DataFrame:
    """Search results of tab-separated files with a ragged right edge.

    columns: name in the file -> Spark type. Columns are found by name in each file's own header; all fields from
    ``protein_column`` on are proteins. A file with a header only, or nothing, gives no rows. ``run`` is the file's base
    name, ``seq`` the order of its lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))
    name = next(iter(columns))
    heads = lines.filter(F.split("value", "\t")[0] == name).groupBy("file").agg(F.split(F.first("value"), "\t").alias("head"))
    rows = lines.filter((F.split("value", "\t")[0] != name) & (F.trim("value") != "")).join(F.broadcast(heads), "file").withColumn("fields", F.split("value", "\t"))
    at = lambda n: F.array_position("head", n).cast("int")
    cols = [F.try_element_at("fields", F.when(at(n) > 0, at(n))).try_cast(t).alias(n) for n, t in columns.items()]
    first = F.when(at(protein_column) > 0, at(protein_column)).otherwise(F.size("head"))
    proteins = F.slice("fields", first, F.greatest(F.lit(0), F.size("fields") - first + 1))
    return rows.select(run_name(F.col("file")).alias("run"), "seq", *cols, proteins.alias("proteins"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_array(text: pd.Series, bits: pd.Series, packed: pd.Series) -> pd.Series:
    """Binary data arrays of spectra: base64, perhaps zlib, little-endian 32- or 64-bit floats."""
    out = []
    for t, b, z in zip(text, bits, packed, strict=True):
        raw = base64.b64decode(t or "")
        out.append(np.frombuffer(zlib.decompress(raw) if z and raw else raw, "<f4" if b == 32 else "<f8").astype(float))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def encode_array(values: pd.Series) -> pd.Series:
    return pd.Series([base64.b64encode(zlib.compress(np.asarray(v, "<f8").tobytes())).decode() for v in values])


_PARAMS = "array<struct<_name:string,_value:string>>"
SPECTRUM = (
    f"_id string, cvParam {_PARAMS}, scanList struct<scan:array<struct<cvParam:{_PARAMS},scanWindowList:struct<scanWindow:array<struct<cvParam:{_PARAMS}>>>>>>, "
    f"precursorList struct<precursor:array<struct<isolationWindow:struct<cvParam:{_PARAMS}>>>>, binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_PARAMS},binary:string>>>"
)


def spectra_scan(spark: SparkSession, path: str, only: DataFrame | None = None, keys: tuple[str, ...] = ("run", "scan_num")) -> DataFrame:
    """Spectra of level 2 and up of mzML files: run (of the file's name), scan_num, rt (minutes), im, window bounds, peaks in m/z order.

    XML is split by element, but decoding it is slow; convert raw spectra to Parquet by run once. For some of the scans of
    large files, see ``mzml.spectra_at``.
    """
    rows = spark.read.format("xml").option("rowTag", "spectrum").schema(SPECTRUM).load(path)
    return spectra(rows.select("*", F.col("_metadata.file_path").alias("path")), F.col("path"), only, keys)


def spectra(rows: DataFrame, file: Column, only: DataFrame | None = None, keys: tuple[str, ...] = ("run", "scan_num")) -> DataFrame:
    """Parsed spectrum elements as spectra. With ``only``, those whose keys it holds: the join stands before the arrays are decoded."""
    flat = lambda a, part: F.flatten(F.transform(F.coalesce(a, F.array()), part))
    own = F.coalesce("cvParam", F.array().cast(_PARAMS))
    scans = F.col("scanList.scan")
    params = F.concat(own, flat(scans, lambda s: s["cvParam"]), flat(scans, lambda s: F.flatten(F.transform(s["scanWindowList"]["scanWindow"], lambda w: w["cvParam"]))))
    isolation = flat(F.col("precursorList.precursor"), lambda p: p["isolationWindow"]["cvParam"])
    scan = F.regexp_extract("_id", r"scan=(\d+)", 1).cast("long")
    rows = rows.select(run_name(file).alias("run"), scan.alias("scan_num"), F.filter(F.coalesce(params, own), lambda p: p.isNotNull()).alias("p"), isolation.alias("iso"), F.col("binaryDataArrayList.binaryDataArray").alias("arrays"))
    param = lambda name, of="p": F.try_element_at(F.filter(of, lambda p: p["_name"] == name), F.lit(1))["_value"]
    array = lambda name: F.try_element_at(F.filter("arrays", lambda a: F.exists(a["cvParam"], lambda p: p["_name"] == name)), F.lit(1))
    wide = lambda a: F.when(F.exists(f"{a}.cvParam", lambda p: p["_name"] == "32-bit float"), 32).otherwise(64)
    packed = lambda a: F.exists(f"{a}.cvParam", lambda p: p["_name"] == "zlib compression")
    rows = rows.filter(param("ms level").cast("int") != 1)
    if only is not None:
        rows = rows.join(only.select(*keys).distinct(), list(keys), "left_semi")
    rows = rows.withColumns({"m": array("m/z array"), "i": array("intensity array")})
    peaks = F.array_sort(F.arrays_zip(decode_array("m.binary", wide("m"), packed("m")).alias("mz"), decode_array("i.binary", wide("i"), packed("i")).alias("intensity")))
    target = param("isolation window target m/z", "iso").cast("double")
    return rows.select(
        "run",
        "scan_num",
        param("scan start time").cast("double").alias("rt"),
        param("inverse reduced ion mobility").cast("double").alias("im"),
        (target - param("isolation window lower offset", "iso").cast("double")).alias("iso_lo"),
        (target + param("isolation window upper offset", "iso").cast("double")).alias("iso_hi"),
        param("scan window lower limit").cast("double").alias("ms2_lo"),
        param("scan window upper limit").cast("double").alias("ms2_hi"),
        peaks.alias("peaks"),
    )


def run_name(path: Column) -> Column:
    """The base name of a file, up to its first dot and without ``_uncalibrated``."""
    return F.regexp_replace(F.regexp_extract(F.substring_index(path, "/", -1), r"^([^.]*)", 1), "_uncalibrated$", "")


def _blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """run, seq, value: the parts of text files between separators, with line feeds alone."""
    rows = spark.read.text(path, lineSep=separator)
    return rows.select(run_name(F.col("_metadata.file_path")).alias("run"), F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


def _mgf_blocks(spark: SparkSession, path: str) -> DataFrame:
    rows = _blocks(spark, path, "END IONS").withColumn("value", F.regexp_replace("value", r"(?m)^#[^\n]*\n", ""))
    return rows.filter(F.col("value").contains("BEGIN IONS"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("value", rf"(?m)^{name}=(.*)$", 1), F.lit(""))


def _mgf_peaks(value: Column, fields: list[str]) -> Column:
    """array of structs of the numbered lines: mz, intensity and further string fields."""
    lines = F.filter(F.split(value, "\n"), lambda s: s.rlike(r"^[0-9.]+[ \t]"))

    def peak(s: Column) -> Column:
        parts = F.split(s, r"[ \t]+")
        more = [F.try_element_at(parts, F.lit(3 + k)).alias(n) for k, n in enumerate(fields)]
        return F.struct(F.element_at(parts, 1).cast("double").alias("mz"), F.element_at(parts, 2).cast("double").alias("intensity"), *more)

    return F.transform(lines, peak)


def mgf_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Blocks as spectra of their file's ``run``; the scan number is the second last dot-part of the title, or its ``Cmpd`` number.

    The first block of a scan of a run wins. Lines may end in CR LF.
    """
    title = _field("TITLE")
    rows = _mgf_blocks(spark, path).select(
        "run",
        "seq",
        F.coalesce(F.nullif(F.regexp_extract(title, r"Cmpd (\d+)", 1), F.lit("")), F.try_element_at(F.split(title, r"\."), F.lit(-2))).try_cast("long").alias("scan_num"),
        F.coalesce(_field("RTINSECONDS").cast("double") / 60, _field("RT").try_cast("double")).alias("rt"),
        F.regexp_extract(title, r"1/K0=([0-9.]+)", 1).try_cast("double").alias("im"),
        F.array_sort(_mgf_peaks(F.col("value"), [])).alias("peaks"),
    )
    first = Window.partitionBy("run", "scan_num").orderBy("seq")
    return rows.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r", "seq")


def mgf_library(spark: SparkSession, path: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Blocks as predictions: precursor, rt, im and fragments with ion type and isotope; ignored ion types are left out."""
    rows = _mgf_blocks(spark, path)
    kept = lambda p: F.coalesce(~p["ion_type"].isin(list(ignored)), F.lit(True)) if ignored else F.lit(True)
    peaks = F.filter(_mgf_peaks(F.col("value"), ["ion_type", "isotope"]), kept)
    precursor = F.concat_ws("|", _field("TITLE"), F.regexp_extract(_field("CHARGE"), r"(\d+)", 1))
    return rows.select(precursor.alias("precursor"), _field("RT").cast("double").alias("rt"), _field("1/K0").cast("double").alias("im"), peaks.alias("fragments"))


def msp_library(spark: SparkSession, path: str, most_charge: int = 8, least_number: int = 1) -> DataFrame:
    """precursor, mods, irt and fragments (mz, intensity, annotation) of the blocks that start with ``Name:``; lines may end in CR LF.

    Zero intensities, charges above and numbers below the bounds are left out.
    """
    rows = _blocks(spark, path, "Name:").filter(F.trim("value") != "")
    head = lambda rx: F.nullif(F.regexp_extract("value", rx, 1), F.lit(""))
    lines = F.filter(F.split("value", "\n"), lambda s: s.rlike(r"^[0-9.]"))

    def peak(s: Column) -> Column:
        parts = F.split(s, "\t")
        note = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")), '"', "")
        return F.struct(F.element_at(parts, 1).cast("double").alias("mz"), F.element_at(parts, 2).cast("double").alias("intensity"), note.alias("annotation"))

    z = lambda p: F.coalesce(F.regexp_extract(p["annotation"], r"\^(\d+)", 1).try_cast("int"), F.lit(1))
    n = lambda p: F.coalesce(F.regexp_extract(p["annotation"], r"^[a-z](\d+)", 1).try_cast("int"), F.lit(least_number))
    kept = F.filter(F.transform(lines, peak), lambda p: (p["intensity"] > 0) & (z(p) <= most_charge) & (n(p) >= least_number))
    name = F.replace(F.trim(F.substring_index("value", "\n", 1)), F.lit("/"), F.lit("|"))
    return rows.select(name.alias("precursor"), head(r"Mods=(\S+)").alias("mods"), head(r"iRT=([-0-9.]+)").cast("double").alias("rt"), kept.alias("fragments"))


def library_tsv(spark: SparkSession, path: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Transitions of a tab-separated library as one row per precursor, ignored ion types left out."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return _grouped(rows, "ModifiedPeptideSequence", "PrecursorCharge", "ProductMz", "LibraryIntensity", "FragmentType", "FragmentSeriesNumber", "FragmentCharge", "NormalizedRetentionTime", "PrecursorIonMobility", ignored)


def library_parquet(spark: SparkSession, path: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The same of a Parquet library: only the columns used are read."""
    rows = spark.read.parquet(path)
    return _grouped(rows, "Modified.Sequence", "Precursor.Charge", "Product.Mz", "Relative.Intensity", "Fragment.Type", "Fragment.Series.Number", "Fragment.Charge", "RT", "IM", ignored)


def _grouped(rows: DataFrame, seq: str, charge: str, mz: str, intensity: str, ion: str, number: str, z: str, rt: str, im: str, ignored: tuple[str, ...]) -> DataFrame:
    c = lambda n: F.col(f"`{n}`")
    key = F.concat_ws("|", F.regexp_replace(F.regexp_replace(c(seq), "^_|_$", ""), r"\((UniMod:\d+)\)", r"[$1]"), c(charge).cast("string"))
    kind = F.substring(c(ion), 1, 1)
    rows = rows.filter(~kind.isin(list(ignored))) if ignored else rows
    fragment = F.struct(c(mz).cast("double").alias("mz"), c(intensity).cast("double").alias("intensity"), kind.alias("ion_type"), c(number).cast("int").alias("frag_num"), c(z).cast("int").alias("charge"))
    return rows.groupBy(key.alias("precursor")).agg(F.first(c(rt).cast("double")).alias("rt"), F.first(c(im).cast("double")).alias("im"), F.array_sort(F.collect_list(fragment)).alias("fragments"))


def library_reduce(library: DataFrame, psms: DataFrame, keys: list[str]) -> DataFrame:
    """Library rows whose keys appear in any search result; Spark broadcasts the keys if they are few."""
    return library.join(psms.select(*keys).distinct(), keys, "left_semi")


def library_allowed(library: DataFrame, allowed: DataFrame | None, key: str = "precursor") -> DataFrame:
    """Library rows of the allowed precursors; all without a list."""
    return library if allowed is None else library.join(allowed.select(key).distinct(), key, "left_semi")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence: lines of a sequence joined, blank lines skipped."""
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim("value") != "")
    return rows.select(F.substring_index("value", "\n", 1).alias("header"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "").alias("sequence"))


PEPXML = "_start_scan long, _assumed_charge int, _retention_time_sec double, search_result struct<search_hit:array<struct<_hit_rank:int,_peptide:string,_protein:string,_massdiff:double,_num_tol_term:int,_num_missed_cleavages:int,search_score:array<struct<_name:string,_value:double>>>>>"


def pepxml(spark: SparkSession, path: str) -> DataFrame:
    """One row per hit: scan, peptide, label (``rev`` decoy), third score, RT seconds, mass difference, termini, missed cleavages and isotope error."""
    rows = spark.read.format("xml").option("rowTag", "spectrum_query").schema(PEPXML).load(path)
    h = rows.select("_start_scan", "_retention_time_sec", F.explode("search_result.search_hit").alias("h"))
    return h.select(
        F.col("_start_scan").alias("scan_num"), F.col("h._peptide").alias("peptide"), F.when(F.col("h._protein").startswith("rev"), 0).otherwise(1).alias("label"),
        F.try_element_at("h.search_score", F.lit(3))["_value"].alias("score"), F.col("_retention_time_sec").alias("rt_seconds"), F.col("h._massdiff").alias("mass_diff"),
        F.col("h._num_tol_term").alias("termini"), F.col("h._num_missed_cleavages").alias("missed"), F.round(F.col("h._massdiff") / 1.00335).cast("int").alias("isotope_error"),
    )


def mod_tables(tables: list[DataFrame], with_residue: bool = False) -> DataFrame:
    """id, mass of several modification tables with different columns; the first table that has an id wins. With residues, the key is residue and id."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("__order", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    masses = [c for c in ("mod_mass", "mass", "delta") if c in out.columns]
    ident = F.coalesce(*(F.col(c).cast("string") for c in ("unimod_id", "mod_name") if c in out.columns))
    if with_residue:
        ident = F.concat(F.when(F.col("residue") == "term", "[").otherwise(F.coalesce("residue", F.lit(""))), ident)
    rows = out.select(ident.alias("id"), F.coalesce(*(F.col(c).cast("double") for c in masses)).alias("mass"), "__order").filter("id is not null and mass is not null")
    return rows.groupBy("id").agg(F.min_by("mass", F.struct("__order", "mass")).alias("mass"))


def unimod_obo(spark: SparkSession, path: str) -> DataFrame:
    """id, mass of the terms of an OBO file."""
    rows = spark.read.text(path, lineSep="[Term]")
    return rows.select(F.regexp_extract("value", r"id: UNIMOD:(\d+)", 1).try_cast("int").alias("id"), F.regexp_extract("value", r'delta_mono_mass "([-0-9.]+)"', 1).try_cast("double").alias("mass")).filter("id is not null and mass is not null")


def peptide_list(rows: DataFrame) -> DataFrame:
    """peptide, charge (trailing digits, else null), proteins, is_decoy."""
    return rows.select(F.regexp_extract("peptide", r"^(.*?)(\d*)$", 1).alias("peptide"), F.nullif(F.regexp_extract("peptide", r"^(.*?)(\d*)$", 2), F.lit("")).cast("int").alias("charge"), "proteins", "is_decoy")


def pair_runs(results: DataFrame, spectra: DataFrame) -> DataFrame:
    """run, result, spectrum: files (``path``) with the same base name, without ``_uncalibrated``; mzML before MGF; edited results left out. A result without spectra has a null.

    Callers check for nulls; the order is by name without case.
    """
    base = lambda c: F.regexp_replace(F.regexp_extract(F.substring_index(c, "/", -1), r"^(.*)\.[^.]+$", 1), "_uncalibrated$", "")
    from massloom.operators.ranks import group_ranks

    left = results.filter(~F.col("path").rlike("_edited|_rescore")).select(base(F.col("path")).alias("run"), F.col("path").alias("result"))
    right = spectra.select(base(F.col("path")).alias("run"), F.col("path").alias("spectrum"), F.when(F.lower("path").endswith(".mzml"), 0).otherwise(1).alias("__p"))
    best = right.withColumn("__r", F.row_number().over(Window.partitionBy("run").orderBy("__p", "spectrum"))).filter("__r = 1").drop("__p", "__r")
    paired = left.join(best, "run", "left").withColumns({"__all": F.lit(0), "__low": F.lower("run")})
    return group_ranks(paired, ("__all",), ("__low", "result"), "place", "__size").select("run", "result", "spectrum", F.col("place").cast("long").alias("place"))


def detectability(peptides: DataFrame, table: DataFrame) -> DataFrame:
    """score of the stripped key, else of the raw one."""
    a = table.select(F.col("peptide").alias("stripped"), F.col("score").alias("__a"))
    b = table.select(F.col("peptide").alias("raw"), F.col("score").alias("__b"))
    return peptides.join(a, "stripped", "left").join(b, "raw", "left").withColumn("score", F.coalesce("__a", "__b")).drop("__a", "__b")
